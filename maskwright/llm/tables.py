"""Small helpers that the operators share: intermediate tables and Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.folders import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no more
    than the tasks it ran and later steps do not compute it again."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_in_buckets(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``: a join by it moves the other side only."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, purpose)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """Send an object of bounded size to the executors, its class by value; ``opened`` reads it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(sent: Broadcast) -> object:
    return cloudpickle.loads(sent.value)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_key(text: str = "text") -> Column:
    """64-bit key of a text; null and empty texts have different keys."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, empty for null."""
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``max_bytes`` of text, at least one row each."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``values``; empty segments give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
