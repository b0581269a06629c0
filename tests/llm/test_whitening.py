"""Whitening against dense eigenvectors of exactly centred vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries, whitening
from maskwright.llm.tables import table

SCHEMA = "vec_id bigint, embedding array<float>, x string, block int, part string"


def dense(vectors, k):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1], turn[:, ::-1]
    own = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviation, values[:k], own @ turn[:, :k], values[:k] / values.sum()


def check(found, ids, vectors, k, close=1e-8):
    n, deviation, values, own, share = dense(vectors, k)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(found) == len(ids) * k and all(r["n"] == n for r in found)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9
    got = np.zeros((len(ids), k))
    for i, v in enumerate(ids):
        for r in by[v]:
            got[i, r["component"] - 1] = r["whitened"]
            assert int(r["deviation"]) == deviation[i] and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-10
    expected = own / np.sqrt(values)
    assert np.abs(got - expected * np.sign((got * expected).sum(axis=0))).max() < close


@pytest.mark.parametrize("d,k", [(5, 16), (20, 16), (40, 3)])
def test_against_dense(spark, monkeypatch, d, k):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 40 * 8 * 7)
    draw = np.random.default_rng(d)
    vectors = [[float(np.float32(c)) for c in v] for v in draw.standard_normal((300, d)) * 0.95 ** np.arange(d) + 3]
    vectors += vectors[:100]  # a third of the rows are copies
    rows = [(i, v, "x", 1, "p") for i, v in enumerate(vectors)]
    nan = [float("nan")] * d
    bad = [(-1, None), (-2, [None] * d), (-3, nan), (-4, [float("inf")] * d), (-5, []), (-6, [1.0]), (-7, [3e38] * d)]
    docs = spark.createDataFrame(rows + [(i, v, "x", 1, "p") for i, v in bad], SCHEMA).repartition(7)
    found = whitening.whiten(docs, k=k).collect()
    check(found, list(range(400)), vectors, min(k, d))


def test_few_vectors_and_none(spark):
    def whitened(vectors):
        rows = [(i, v, "x", 1, "p") for i, v in enumerate(vectors)]
        return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()

    assert whitened([]) == whitened([[1.0, 2.0]] * 3) == whitened([[], None]) == []
    found = whitened([[1.0, 2.0, 3.0], [2.0, 2.0, 3.0], [2.0, 2.0, 3.0], [5.0, 2.0, 3.0]])  # one direction only
    assert {r["component"] for r in found} == {1} and len(found) == 4 and found[0]["n"] == 3
    assert [r["whitened"] for r in found if r["vec_id"] in (1, 2)] == [found[1]["whitened"]] * 2


def test_deviations_beyond_a_long_are_exact(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**41), 7.0], [2.0**39, -5.0], [0.0, 0.0]]
    rows = [(i, v, "x", 1, "p") for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), k=1).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    assert [int(r["deviation"]) for r in sorted(found, key=lambda r: r["vec_id"])] == [
        sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for v in x
    ]


def test_minres_and_pairs():
    draw = np.random.default_rng(0)
    a = draw.standard_normal((30, 30))
    a = a + a.T
    b = draw.standard_normal((30, 2))
    assert np.abs(a @ whitening._minres(lambda w: a @ w, b, 100, 1e-14) - b).max() < 1e-10
    q = np.linalg.qr(draw.standard_normal((200, 200)))[0]
    for spectrum in (0.8 ** np.arange(200), np.r_[[3.0] * 5, [1.0] * 195], np.linspace(2, 1, 200)):
        v = (q * spectrum) @ q.T
        values, vectors = whitening.leading_pairs(lambda w: v @ w, 200, 8)
        assert np.abs(values - spectrum[:8]).max() < 1e-13 * 3
        assert np.abs(v @ vectors - vectors * values).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13


def test_query_over_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r for r in table(spark, sf, "embeddings").collect() if r["embedding"] is not None and all(math.isfinite(c) for c in r["embedding"])]
    df = queries.QUERIES["op13_whitening"](spark, sf)
    assert dict(df.dtypes)["deviation"] == "bigint" and df.filter(F.col("deviation").isNull()).count() == 0
    check(df.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 16)
