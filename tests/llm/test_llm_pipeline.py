"""The pipeline's stages on odd rows and on planted cases, and the registered queries."""

import functools
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_fingerprint, brute_lines

import __spark_entry__ as spark_entry
import check_queries
import corpus_pipeline
from maskwright.llm import langid, queries
from maskwright.llm.tables import table, text_key

SF = "/root/testdata/sf0.001"
#: Names that the stages' own columns have had.
OWN = ["mix_size", "mix_note", "__key", "__id", "__other", "__gone", "__lines", "__removed", "__row", "row", "key", "id"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RUSSIAN = "Это обычный русский текст о старой реке, мостах и осенних листьях в гавани."
GREEK = "Αυτό είναι ένα απλό ελληνικό κείμενο για το παλιό ποτάμι και τις γέφυρες."
NOISE = "xkcd qwrt zzxv plkm wqzx vbnm jjqp xvvk qzkw fjxq wvbz kqjx"


@pytest.fixture(scope="module")
def odd(spark):
    docs = table(spark, SF, "documents")
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    clean = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    rows = [
        (9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "... 12", "en", "a", 6),
        (None, "und hier ist ein kurzer Satz ohne Nummer", "de", None, 5), (9004, f"before it {item} after it", "en", "a", 1),
        (9005, clean + " one more ending", "en", "a", 1), (9006, "the a", "en", "a", 3), (9006, "the a", "en", "a", 3),
        (9007, RUSSIAN, "en", "a", 3), (9008, GREEK, None, "a", 3), (9009, NOISE, "en", "b", 3), (9010, clean, "en", None, 7),
        (9011, " ".join(f"the {w} of {w}" for w in clean.split() * 40), "en", "b", 1),
    ]
    both = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    return both.select("*", *[F.lit(c).alias(c) for c in OWN]).repartition(5).cache()


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


def plain(df):
    return sorted((tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect()), key=repr)


def brute_language(spark, rows, model):
    """Word by word, with a plain Viterbi."""
    kept = []
    fits_of = functools.cache(lambda w: model.word_fits([w]))
    for r in rows:
        words = [langid._letters(w) for w in (r[1] or "").lower().split()]
        fits = [fits_of(w) for w in words]
        best, back = np.zeros(len(model.languages)), []
        for f in fits:
            step = np.array([[v - 8.0 * (i != j) for i, v in enumerate(best)] for j in range(len(best))])
            stay = np.arange(len(best))
            choice = np.where(step.max(axis=1) > best, step.argmax(axis=1), stay) if back else stay
            back.append(choice)
            best = step[stay, choice] + f[0][0] if len(back) > 1 else best + f[0][0]
        label = int(best.argmax()) if fits else 0
        labels = []
        for choice in reversed(back):
            labels.append(label)
            label = int(choice[label])
        labels.reverse()
        letters = sum(f[1][0] for f in fits)
        if not letters:
            continue
        share = max(sum(f[1][0] for f, k in zip(fits, labels) if k == j) for j in range(len(best))) / letters
        known = sum(f[4][0] for f in fits) / letters
        excess = sum(f[2][0][k] - f[3][0] * model.typical[k] for f, k in zip(fits, labels))
        fit = excess / sum(f[3][0] * model.spread[k] for f, k in zip(fits, labels))
        if share >= 1 / 3 and known >= 0.5 and fit >= -(1.75 + 1 / np.sqrt(letters)):
            kept.append(r)
    return kept


def brute_near_duplicates(rows):
    marked = [(r, brute_fingerprint(r[1])) for r in rows]
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(marked):
        for j in range(i):
            if (a ^ marked[j][1]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for g, (r, _) in zip(group, marked):
        first[g] = min(first.get(g, r), r, key=lambda x: (x[0] is not None, x[0] or 0))
    return sorted(first.values(), key=repr)


def brute_leaks(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(rows))), "text": pa.array([r[1] for r in rows], pa.string())}))
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    gone = {r[0] for r in con.execute(queries.ORACLES["op8_decontaminate"]).fetchall()}
    return [r for i, r in enumerate(rows) if i not in gone]


def brute_mixture(spark, rows):
    """Every source's documents along a line in the seeded order; those whose middle lies before the
    target, or before it the second time round, are taken."""
    docs = spark.createDataFrame(rows, SCHEMA)
    named = docs.select("*", F.struct("doc_id", text_key().alias("key")).cast("string").alias("name")).collect()
    sized = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), int(hashlib.md5(f"17:{r['name']}".encode()).hexdigest()[:15], 16)) for r in named]
    sizes = {}
    for r, n, _ in sized:
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = 0.0  # the water level at which the targets add up
    low, high = 0.0, 2.0 * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * sizes[s], weight[s] * level) for s in order) < 1.5 * sum(sizes.values()):
            low = level
        else:
            high = level
    out = []
    for s in order:
        target = min(2 * sizes[s], weight[s] * level)
        at = 0
        for r, n, _ in sorted((x for x in sized if x[0]["source"] == s), key=lambda x: (x[2], x[0]["name"])):
            uses = sum(2 * (at + k * sizes[s]) + n < 2 * int(target + 0.5) for k in range(2)) if n else 0
            at += n
            if uses:
                out.append((r["doc_id"], n, n * uses, round(target, 3)))
    return sorted(out, key=repr)


def test_stages_and_run_against_brute_force(spark, odd, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark_leaks", "mixture"]
    rows = plain(odd)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language":
            rows = brute_language(spark, rows, langid.fit(docs))
            assert not {r[0] for r in rows} & {9001, 9002, 9003, 9007, 9008, 9009} and len(rows) == odd.count() - 6
        elif name == "lines":
            cut = brute_lines([(i, r[1]) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))])
            in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
            rows = [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, t in zip(in_order, cut.values()) if t.strip() or t == r[1]]
        elif name == "near_duplicates":
            rows = brute_near_duplicates(rows)
        else:
            rows = brute_leaks(rows)
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == odd.columns and plain(docs) == sorted(rows, key=repr), name
        assert docs.filter(" and ".join(f"`{c}` = '{c}'" for c in OWN)).count() == docs.count()
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert 9004 not in ids(docs) and None in ids(docs) and len(rows) > 20
    found = corpus_pipeline.mixture(spark, docs, SF)
    assert found.columns == [*[c for c in odd.columns if c != "mix_size"], "mix_size", "mix_taken", "mix_target"]
    expected = brute_mixture(spark, rows)
    assert sorted(((r["doc_id"], r["mix_size"], r["mix_taken"], round(r["mix_target"], 3)) for r in found.collect()), key=repr) == expected
    assert corpus_pipeline.mixture(spark, odd.limit(0), SF).count() == 0
    for name in ("documents", "benchmark"):
        (odd if name == "documents" else table(spark, SF, name)).write.parquet(f"{tmp_path}/{name}.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r["doc_id"], r["mix_size"], r["mix_taken"], round(r["mix_target"], 3)) for r in whole.collect()), key=repr) == expected


def test_stages_judged_alone(spark, odd):
    """Each stage on the raw rows: nulls, repeats and clashing columns do not stop it, clean rows stay."""
    clean = {r["doc_id"] for r in table(spark, SF, "documents").collect()}
    for name, stage in corpus_pipeline.STAGES:
        if name == "near_duplicates":
            continue  # above it has the rows of the stages before, nearly all
        found = stage(spark, odd, SF)
        kept = set(ids(found))
        if name == "language":
            assert clean <= kept
        if name == "benchmark_leaks":
            assert plain(found) == sorted(brute_leaks(plain(odd)), key=repr)
        assert len(kept) > 50, name


def test_lines_drop_only_what_repeats(spark):
    rows = [(1, "a\nb\nc\nown"), (2, "a\nb\nc"), (3, "x\na\nb\nc"), (4, ""), (5, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit(-1))
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert found == {1: ("a\nb\nc\nown", -1), 3: ("x", 1), 4: ("", -1), 5: ("a\nb", -1)}


def test_language_keeps_short_clean_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lost = set(ids(docs)) - set(ids(corpus_pipeline.language(spark, docs, "")))
    letters = {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert not lost & letters


def test_run_is_registered(spark):
    assert spark_entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.QUERIES) <= set(spark_entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in spark_entry.queries()) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check_queries.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check_queries.rows_of(df.columns, mine) == check_queries.rows_of(columns, cursor.fetchall())


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.identify(docs, langid.fit(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").filter("toxic is not null")
    found = queries.QUERIES["op2_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id")
    by = {r["toxic"]: r["m"] for r in found.groupBy("toxic").agg(F.avg("predicted").alias("m")).collect()}
    assert by[1] > 0.85 and by[0] < 0.03


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").filter("quality is not null")
    found = queries.QUERIES["op9_quality"](spark, sf).join(labels, "doc_id")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
