"""Reading texts and writing findings, masked texts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import scoring

ROWS_PER_TASK = 5000


def dealt(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows dealt out by ``key``, about ``rows_per_task`` to a task.

    A scan is cut by bytes and never inside a row group, so a narrow table whose columns make texts is
    one task's work however many rows it has. Shuffle the narrow rows, then make the texts. ``key`` is
    unique, or nearly so; counting the rows reads the ends of the files only.
    """
    tasks = -(-df.count() // rows_per_task)
    return df.repartition(tasks, key) if tasks > 1 else df


def read_texts(spark: SparkSession, path: str, fmt: str = "text", text_col: str = "text") -> DataFrame:
    """Texts as (path, text) from whole files, or the rows of a table file.

    ``text``: every file is one text, as a whole. ``lines``: every line is one text.
    ``parquet``, ``json``, ``orc`` and ``csv``: ``text_col`` is renamed to ``text``.
    """
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
        )
    if fmt == "lines":
        return spark.read.text(path).select(
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
        )
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path).withColumnRenamed(text_col, "text")


def findings(df: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """One row per detected span of sufficient confidence, next to the row's other columns."""
    nested = {"entities", "detection_metadata"}
    others = [c for c in df.columns if c not in nested]
    return df.select(
        *others, F.explode(scoring.filter_confidence(F.col("entities"), min_confidence)).alias("__e")
    ).select(
        *others,
        F.col("__e.entity_type").alias("type"),
        F.col("__e.text").alias("matched_text"),
        F.col("__e.confidence").alias("confidence"),
        F.col("__e.start").alias("start"),
        F.col("__e.end").alias("end"),
    )


def write_findings(
    df: DataFrame, path: str, fmt: str = "json", min_confidence: float = 0.8, mode: str = "errorifexists"
) -> None:
    findings(df, min_confidence).write.mode(mode).format(fmt).save(path)


def write_masked(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Masked texts; the originals and the spans (which quote them) are not written."""
    private = {"text", "entities", "entities_masked", "provided_entities"}
    kept = df.select(*[c for c in df.columns if c not in private])
    if fmt == "text":
        kept = kept.select("masked_text")
    kept.write.mode(mode).format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
