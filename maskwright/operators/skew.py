"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000
#: What a sketch of frequent keys keeps, whatever the number of rows; its error is 3.5 / TRACKED of them.
CANDIDATES, TRACKED = 1024, 4096


def hot_keys(counts: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(key, slices) of all keys with more rows than one task should take.

    ``counts`` is (key, n) with one row per key.
    """
    return counts.filter(F.col("n") > rows_per_slice).select(
        key, F.ceil(F.col("n") / rows_per_slice).cast("int").alias("__slices")
    )


def frequent(rows: DataFrame, key: Column) -> DataFrame:
    """(__h, n): exact counts of the hashes of keys that may be frequent, at most ``CANDIDATES``.

    Tasks keep sketches of bounded size, which merge; only the candidates that come of them are
    counted. A key with more than a thousandth of the rows is among them. Null keys are left out.
    """
    hashed = rows.filter(key.isNotNull()).select(F.xxhash64(key).alias("__h"))
    top = hashed.agg(F.expr(f"approx_top_k(__h, {CANDIDATES}, {TRACKED})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("__h"))
    return hashed.join(F.broadcast(candidates), "__h", "left_semi").groupBy("__h").agg(F.count("*").alias("n"))


def join_unique(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    row_id: list[Column],
    how: str = "left",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join ``rows`` with ``lookup`` (one row per key), splitting hot keys over many tasks.

    Rows of a hot key get a slice number from a hash of ``row_id`` (so a retried task gives the
    same number); the key's single lookup row is repeated once per slice. Other keys join as
    usual. Every row is joined exactly once. Hot keys are found by a sketch: those with more than
    ``rows_per_slice`` rows, if that is a thousandth of all rows or more; a rarer key is no more
    than one of many that a task takes.
    """
    hot = F.broadcast(hot_keys(frequent(rows, F.col(key)), "__h", rows_per_slice))  # at most CANDIDATES rows
    sliced = rows.withColumn("__h", F.xxhash64(key)).join(hot, "__h", "left").withColumn(
        "__slice", F.pmod(F.xxhash64(*row_id), F.coalesce("__slices", F.lit(1))).cast("int")
    )
    repeated = (
        lookup.withColumn("__h", F.xxhash64(key))
        .join(hot, "__h", "left")
        .withColumn("__slice", F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1)))
        .drop("__slices", "__h")
    )
    return sliced.drop("__slices", "__h").join(repeated, [key, "__slice"], how).drop("__slice")
