"""Line dedup: three consecutive lines that stand anywhere else before are removed.

Every overlapping window of three non-blank lines is hashed; the windows of all documents that share
a hash are found by one aggregation; and all of them but the first lose their lines. Lines that
several repeated windows cover are removed once. Column expressions only, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import let
from maskwright.llm.tables import saved, text_key

WINDOW = 3


def _windows(lines: Column, window: int) -> Column:
    """One struct per window: places of its lines, and two hashes of them."""

    def of(lines: Column) -> Column:
        numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
        return let(F.filter(numbered, lambda x: F.trim(x["line"]) != ""), all_of)

    def all_of(full: Column) -> Column:
        def one(i: Column) -> Column:
            own = [F.get(full, i + k) for k in range(window)]
            texts = [x["line"] for x in own]
            return F.struct(
                F.array(*[x["i"] for x in own]).alias("places"),
                F.xxhash64(*texts).alias("h0"),
                F.xxhash64(F.lit(1), *reversed(texts)).alias("h1"),
            )

        return F.when(F.size(full) >= window, F.transform(F.sequence(F.lit(0), F.size(full) - window), one))

    return let(lines, of)


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` less its repeated lines, and two more columns,
    ``__lines`` and ``__removed`` (numbers of lines).

    Lines end at \\n and are compared as they are; blank ones belong to no window and stay. The
    first of equal windows is that of the smallest doc_id (null first), then of the smallest text
    key, then the first in the text. A text with fewer than ``window`` lines that are not blank
    stays as it is, and null stays null (0 lines). Rows with equal doc_id and text are one document:
    their windows do not repeat each other. A line of a removed window is removed even where an
    earlier, kept window overlaps it. An empty table gives no rows. Own columns of the two new names
    are replaced, all others come back as they are.
    """
    lines = F.split(F.col("text"), "\n")
    key = docs.select("doc_id", text_key().alias("__key"), "text")
    found = saved(
        key.select("doc_id", "__key", F.explode(_windows(lines, window)).alias("w")).select(
            "doc_id", "__key", "w.places", "w.h0", "w.h1"
        ),
        "windows",
    )
    at = F.struct("doc_id", "__key", "places")
    ends = found.groupBy("h0", "h1").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    ends = saved(ends.filter("first <> last").select("h0", "h1", "first"), "repeated")
    later = found.join(ends, ["h0", "h1"]).filter(~at.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "__key").agg(F.collect_set("places").alias("__sets"))  # bounded by the text's lines
    gone = gone.select(
        F.col("doc_id").alias("__id"), F.col("__key").alias("__other"), F.array_distinct(F.flatten("__sets")).alias("__gone")
    )
    # The other columns travel in one, whatever their names.
    marked = docs.select("doc_id", text_key().alias("__key"), "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"))
    joined = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__other")), "left")

    def without(own: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n")

    text = let(lines, without)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(text)
    whole = [(text if c == "text" else F.col("__row")[c]).alias(c) for c in docs.columns if c not in ("__lines", "__removed")]
    counts = [F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("__gone"), F.lit(0))]
    counts = [F.when(F.col("text").isNull(), 0).otherwise(counts[0]).alias("__lines")] + [
        F.when(F.col("__gone").isNull(), 0).otherwise(counts[1]).alias("__removed")
    ]
    return joined.select(*whole, *counts)
