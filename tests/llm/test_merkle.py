"""The manifest against a plain tree, proofs included."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, digest string, position string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def way(levels, i, arity):
    """(before, after) on the way from node i of the first level up."""
    steps = []
    for nodes in levels[:-1]:
        run = i - i % arity
        steps.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + arity])))
        i //= arity
    return steps


def brute(rows, arity=2):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    inner = {}
    for t in order:
        own = sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[t] = own, levels_of([leaf(r) for r in own], arity)
    top = levels_of([inner[t][1][-1][0] for t in order], arity)
    out = []
    for k, t in enumerate(order):
        own, levels = inner[t]
        for i, r in enumerate(own):
            steps = way(levels, i, arity) + way(top, k, arity)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for before, after in steps:
                folded = h(before, folded, after)
            root = top[-1][0]
            out.append((r[0], leaf(r), levels[-1][0], root, h(*[x for s in steps for x in s]), folded, folded == root))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "own", "p") for r in rows], SCHEMA)
    n = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.manifest(docs.repartition(3), altered={"n_chars": n}, **more)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


ODD = [
    (1, "a", "en", 3, "abc"), (2, None, "en", None, None), (3, "", "", 0, ""), (None, "a", None, 1, "é東"), (None, "a", None, 1, "é東"),
    (4, "b", "fr", 3, "3:abc-"), (5, "a", "en", 3, "x" * 200_000), (5, "a", "en", 3, "tie"), (5, "a", "en", 3, "tie"), (6, "a", "é", -4, "a\nb/*"),
    (7, "a", None, 1, "z"), (-9, "a", "en", 1, "z"),
]


@pytest.mark.parametrize("subtree", [4, 4096])
@pytest.mark.parametrize("arity", [2, 3])
def test_against_brute_force(spark, monkeypatch, subtree, arity):
    monkeypatch.setattr(merkle, "SUBTREE", subtree)
    many = [(i, "s", ("en", "de")[i % 5 == 0], i, f"text {i}") for i in range(100, 403)]
    for rows in (ODD, many, ODD + many, many[:1], many[:2], [(i, "s", f"lang{i}", 1, "t") for i in range(37)]):
        assert found(spark, rows, arity=arity) == brute(rows, arity)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_tampering_is_what_fails(spark):
    rows = [(i, "s", "en", i if i % 3 else None, "t") for i in range(200)]
    for r in found(spark, rows):
        assert r[6] == (zlib.crc32(str(r[0]).encode()) % 7 != 0 or r[0] % 3 == 0)
