"""Work on texts made from a narrow table is spread, however the table's file is cut."""

from pyspark.sql import functions as F

from maskwright.plans.corpus import corpus
from maskwright.sources import texts


def test_texts_of_one_row_group_span_tasks(spark, tmp_path):
    rows = 3 * texts.ROWS_PER_TASK
    spark.range(1, rows + 1).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = corpus(spark, str(tmp_path))
    sizes = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 1.2 * texts.ROWS_PER_TASK
    assert sorted(r[0] for r in made.select("doc_id").collect()) == list(range(1, rows + 1))


def test_small_and_empty_tables_stay_as_they_are(spark):
    few = spark.range(10)
    assert texts.dealt(few, "id") is few
    assert texts.dealt(few.filter("id < 0"), "id").count() == 0
    assert sorted(r[0] for r in texts.dealt(few, "id", 4).collect()) == list(range(10))
