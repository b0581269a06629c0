"""Best cosines of sorted groups against plain loops, and how rows reach them."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.functions import nearest
from maskwright.operators import semantic


def in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def unit(v):
    size = math.sqrt(in_order(v, v))
    return [x / (size if size > 0 else 1.0) for x in v]


@pytest.mark.parametrize("cells", [1, 50, 10_000])
def test_sums_are_those_of_a_loop_however_rows_are_cut(monkeypatch, cells):
    monkeypatch.setattr(nearest, "CELLS", cells)
    rng = random.Random(8)
    rows = [[rng.gauss(0, 1) for _ in range(33)] for _ in range(40)] + [[0.0] * 33, [1e-170] * 33]
    units = [unit([rng.gauss(0, 1) for _ in range(33)]) for _ in range(20)]
    units += [unit([x * 3 for x in rows[0]]), unit(rows[0])]  # equal but for rounding
    want = [max(in_order(unit(r), u) for u in units) for r in rows]
    assert nearest.best_cosines(np.array(rows), np.array(units)).tolist() == want
    odd = nearest.best_cosines(np.array([[math.inf, 1.0], [3.0, 4.0]]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert math.isnan(odd[0]) and odd[1] == 0.8
    assert np.isnan(nearest.best_cosines(np.array([[3.0, 4.0]]), np.array([[1.0, 0.0], [math.nan, 0.0]]))).all()


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_groups_go_on_over_batches(size):
    rows = [
        (None, 0, False, [1.0, 0.0]), (None, 1, False, [1.0, 0.0]),
        ("a", 0, True, [1.0, 0.0]), ("a", 0, True, [0.0, 1.0]), ("a", 0, True, [1.0]), ("a", 0, True, None), ("a", 0, True, [None, 1.0]),
        ("a", 0, False, [3.0, 4.0]), ("a", 0, False, [-2.0]), ("a", 0, False, None), ("a", 0, False, [None, 5.0]), ("a", 0, False, [1.0, 1.0, 1.0]),
        ("a", 1, False, [3.0, 4.0]), ("b", 1, True, [1.0, 0.0]), ("b", 1, False, [3.0, 4.0]), ("c", 1, False, [3.0, 4.0]), ("c", 2, True, [1.0, 0.0]),
        ("d", 0, True, []), ("d", 0, False, []), ("d", 0, False, [1.0]),
    ]
    types = [pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.float64())]
    whole = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    batches = [tuple(c[at : at + size] for c in whole) for at in range(0, len(rows), size)]
    got = [x for out in nearest.nearest_of_groups(iter(batches)) for x in out.to_pylist()]
    found = {7: 0.8, 8: -1.0, 14: 0.6, 18: 0.0}
    assert [got[i] for i, r in enumerate(rows) if not r[2]] == [found.get(i) for i, r in enumerate(rows) if not r[2]]
    assert list(nearest.nearest_of_groups(iter([tuple(c[:0] for c in whole)])))[0].to_pylist() == []


def test_rows_are_dealt_out_and_not_grouped_again(spark, monkeypatch):
    monkeypatch.setattr(semantic, "ROWS_PER_SLICE", 20)
    spans = spark.range(2000).selectExpr(
        "id", "case id % 2 when 0 then 'PERSON' end as entity_type", "array(1.0, id) as embedding", "if(id % 3 = 0, null, array(id, 1.0)) as context_embedding"
    )
    protos = spark.createDataFrame([("pattern", "EMAIL", [1.0, 0.0])], "kind string, label string, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = semantic.semantic_scores(spans, protos)  # neither a type's nor a context's prototypes are there
        assert "any_value" not in found._jdf.queryExecution().toString()
        tasks = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(tasks) == 2000 and len(tasks) >= 6 and max(tasks) < 700


def test_many_spans_of_a_type_with_one_prototype_span_tasks(spark, monkeypatch):
    """Slices by comparisons alone would leave such a type, and the only context, to one task each."""
    monkeypatch.setattr(semantic, "ROWS_PER_SLICE", 20)
    spans = spark.range(2000).selectExpr(
        "'mail' as text", "'EMAIL' as entity_type", "0 as start", "4 as end", "0.5D as confidence", "array(3.0, 4.0 + id % 7) as embedding", "array(id, 1.0) as context_embedding"
    )
    protos = spark.createDataFrame([("pattern", "EMAIL", [3.0, 4.0]), ("context", "c", [1.0, 0.0])], "kind string, label string, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = semantic.enhance(spans, protos)
        tasks = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("pattern_similarity").alias("best")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["n"] for r in tasks) == 2000 and len(tasks) >= 6 and max(r["n"] for r in tasks) < 700
    assert {round(r["best"], 12) for r in tasks} == {1.0}
