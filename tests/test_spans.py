"""Span extraction against Python's re, and properties of the span algebra."""

import random
import time
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from maskwright.functions import masking, registry, scoring, spans
from maskwright.functions.regex import jvm_regex, replacing
from maskwright.operators.detect import detect
from maskwright.operators.sanitize import mask_uniform, scan_output

TRICKY = [
    "a é123-45-6789 b 987-65-4321",
    "😀 mail x.y@ex.com, x.y@ex.com2 and é@x.com",
    "١٢٣-٤٥-٦٧٨٩ and 123-45-6789",
    "reſtricted RESTRICTED Confidentıal CONFİDENTİAL internal only",
    "की12345678है x@y.coḿ z éx@y.com",
    "𝐀123456789 123456789𝐀 x²12345678 12345678½",
    "sep\x1c123 45 6789 123\x1f45\x1f6789 123 45 6789 1234\x1c-",
    "_123456789 123456789_ -123456789- .a@b.co é.a@b.co %a@b.|| a@b.c|d é+1 555 123 4567 é(555) 123-4567",
    "pk_live_" + "a" * 24 + "sk-" + "B" * 50 + " x" + "9" * 31 + " " + "9" * 32,
    "2001:db8:0:0:0:0:0:1 1.2.3.4.5 999.999.999.999 1.2.3.4a",
    "https://ex.org:8080/a/b_c.d?x=1&y=%20#frag http://ü.de/ä?ß#ö https://a-b.c/d-e",
    "EMP1234 EMP12345678 EMP123456789 AB-1234 ABCDE-1234 AB-12345 A1234567 AB123456789",
    "mark  123-45-6789  a@b.co",
    "",
    " ",
]


def python_spans(text):
    found = []
    for seq, r in enumerate(registry.RECOGNIZERS):
        for m in re.finditer(r.pattern, text, re.IGNORECASE if r.ignore_case else 0):
            found.append((seq, r.entity_type, m.start(), m.end(), m.group()))
    return sorted(found)


def spark_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    rows = df.select("id", spans.recognize(F.col("text")).alias("s")).collect()
    return {r["id"]: sorted((s["seq"], s["entity_type"], s["start"], s["end"], s["text"]) for s in r["s"]) for r in rows}


def test_tricky_texts_match_python(spark):
    got = spark_spans(spark, TRICKY)
    for i, text in enumerate(TRICKY):
        assert got[i] == python_spans(text), text


def test_random_texts_match_python(spark):
    rng = random.Random(7)
    alphabet = list("0123456789" * 4 + "aZ@.-+() :/_#?&=%|\n\t" + "éß٣²½𝐀😀ı́ी ") + [
        "AKIA", "EMP", "sk-", "pk_x_", "http://", "@company.com", "123-45-6789", "4532", "555-", "ABC", "CONFIDENTIAL", "1.2.3.4",
        "a1b2c3d4e5f6a7b8", "12345678", "0:0:0:", "x@y.io ",
    ]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    got = spark_spans(spark, texts)
    wrong = [t for i, t in enumerate(texts) if got[i] != python_spans(t)]
    assert not wrong, (wrong[0], python_spans(wrong[0]))


def test_gates_and_leads_hide_nothing_in_the_tables(spark):
    ungated = [
        registry.Recognizer(r.entity_type, r.pattern, r.source, r.keywords, r.ignore_case)
        for r in registry.RECOGNIZERS
    ]
    for name, column in [("documents", "text"), ("pages", "html"), ("pages", "url"), ("conversations", "text")]:
        df = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").repartition(8)
        text = F.col(column)
        differ = df.filter(spans.recognize(text) != spans.recognize(text, rows=ungated)).count()
        assert differ == 0, name


def test_tables_match_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] for r in rows]
    got = spark_spans(spark, texts)
    assert all(got[i] == python_spans(t) for i, t in enumerate(texts))


def python_resolve(found):
    kept = []
    for s in sorted(found, key=lambda s: (s[0], s[1])):
        if kept and s[0] <= kept[-1][1]:
            if s[2] > kept[-1][2]:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def test_resolve_overlaps_against_fold(spark):
    rng = random.Random(3)
    cases = []
    for i in range(500):
        found = []
        wide = 400 if i % 5 == 0 else 1
        for _ in range(rng.randint(0, 200 if wide > 1 else 12)):
            start = rng.randint(0, 30 * wide)
            found.append((start, start + rng.randint(1, 10), rng.choice([0.7, 0.8, 0.9])))
        cases.append((i, found))
    rows = [
        (i, [(s, e, n, "T", c, "pattern", "x") for n, (s, e, c) in enumerate(found)]) for i, found in cases
    ]
    df = spark.createDataFrame(rows, f"id int, spans array<{spans.RAW_SPAN}>")
    for r in df.select("id", spans.resolve_overlaps(F.col("spans")).alias("k")).collect():
        got = [(s["start"], s["end"], s["confidence"]) for s in r["k"]]
        assert got == python_resolve(cases[r["id"]][1])


def test_resolved_spans_are_separate_and_text_between_is_kept(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8)
    for r in scan_output(df).filter(F.size("entities") > 0).select("text", "entities", "redacted_text").collect():
        at, expected = 0, ""
        for e in r["entities"]:
            assert at == 0 or e["start"] > at
            expected += r["text"][at : e["start"]] + f"[REDACTED_{e['entity_type']}]"
            at = e["end"]
        assert r["redacted_text"] == expected + r["text"][at:]


def test_splice_any_follows_python_slices(spark):
    rng = random.Random(5)
    cases = []
    for i in range(600):
        text = "".join(rng.choice("abcdé😀") for _ in range(rng.randint(0, 20)))
        given = []
        for _ in range(rng.randint(0, 5) if i % 2 else rng.randint(0, 40)):
            start = rng.randint(0, 22) if i < 300 else rng.randint(0, len(text))
            given.append(("T%d" % rng.randint(0, 3), start, start + rng.choice([0, 1, 3, 6, 15, 40, 10**9])))
        cases.append((i, text, given))
    text = "".join(rng.choice("abcdé😀") for _ in range(9000))
    places = [rng.randint(0, 9000) for _ in range(1500)]
    cases.append((600, text, [("U", s, s + rng.randint(0, 60)) for s in places]))
    rows = [(i, t, [(k, s, e, 0.9, "", "") for k, s, e in g]) for i, t, g in cases]
    df = spark.createDataFrame(rows, f"id int, text string, g array<{spans.SPAN}>")
    out = df.select("id", spans.splice_any(F.col("text"), F.col("g"), masking.redacted).alias("o")).collect()
    for r in out:
        _, text, given = cases[r["id"]]
        for k, s, e in sorted(given, key=lambda g: g[1], reverse=True):
            text = text[:s] + f"[REDACTED_{k}]" + text[e:]
        assert r["o"] == text


def test_many_overlapping_spans_in_a_long_text(spark):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh ", k=1_000_000))
    given = [("T", s, s + rng.randint(1, 300), 0.9, "", "") for s in (rng.randint(0, 1_000_000) for _ in range(20_000))]
    df = spark.createDataFrame([(text, given)], f"text string, g array<{spans.SPAN}>").cache()
    df.count()
    out = df.select(spans.splice_any(F.col("text"), F.col("g"), masking.redacted).alias("o"))
    started = time.time()
    got = out.first()["o"]
    assert time.time() - started < 10
    for k, s, e, *_ in sorted(given, key=lambda g: g[1], reverse=True):
        text = text[:s] + f"[REDACTED_{k}]" + text[e:]
    assert got == text


def test_sentences(spark):
    text = "One. Two!! Three?  Four has 123-45-6789 in it... End"
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(
        spans.sentence_split(F.col("text")).alias("all"),
        spans.sentence_of_span(F.col("text"), F.lit(5), F.lit(8)).alias("hit"),
        spans.sentence_of_span(F.col("text"), F.lit(200), F.lit(203)).alias("miss"),
    ).first()
    assert row["all"] == ["One", "Two", "Three", "Four has 123-45-6789 in it", "End"]
    assert row["hit"] == "Two"
    assert row["miss"] == text[150:253]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1, allow_nan=False), min_size=200, max_size=200))
def test_two_decimals_equal_python(spark, values):
    exact = [i / 1000 for i in range(1001)] + [i / 16 for i in range(17)]
    rows = [(float(v),) for v in [*values, *exact]]
    df = spark.createDataFrame(rows, "v double")
    for r in df.select("v", scoring.two_decimals(F.col("v")).alias("t")).collect():
        assert r["t"] == f"{r['v']:.2f}"


def test_large_texts(spark):
    many = " ".join(f"10.0.{i % 256}.{i % 199}" for i in range(20_000))
    texts = ["x" * 100_000, "a." * 50_000, "http://" + "a" * 200_000, "http://" + "é😀a" * 50_000, "1" * 100_000, many, ("a" * 30 + " ") * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(8)
    rows = {r["id"]: r["entities"] for r in detect(df).select("id", "entities").collect()}
    assert [(e["entity_type"], e["start"], e["end"]) for e in rows[0]] == [("API_KEY", 0, 100_000)]
    assert rows[1] == []
    assert rows[2][0]["entity_type"] == "API_KEY" or rows[2][0]["end"] == len(texts[2])
    assert len(rows[5]) == 20_000
    assert all(texts[5][e["start"] : e["end"]] == e["text"] for e in rows[5])
    assert rows[6] == []
    masked = mask_uniform(df.filter("id = 5"), "redact").select("masked_text").first()[0]
    assert masked == " ".join(["[REDACTED_IP_ADDRESS]"] * 20_000)


def test_own_recognizer(spark):
    own = registry.Recognizer("TICKET", r"\bTCK-\d{3}\b", keywords=("ticket",), gate=("TCK-",))
    df = spark.createDataFrame([("ticket TCK-123 and x TCK-12",)], "text string")
    row = detect(df, rows=[own]).first()
    assert [(e["entity_type"], e["text"], e["confidence"]) for e in row["entities"]] == [("TICKET", "TCK-123", 0.9)]


@pytest.mark.parametrize("pattern", [r"\bé\b", r"[\d-]x", r"\s+\w"])
def test_spelled_out_classes(spark, pattern):
    texts = ["é", "aé", " é ", "٣x", "-x", "\x1cw", " é", "́é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.rlike("t", F.lit(jvm_regex(pattern))).alias("m")).collect()
    assert all(r["m"] == bool(re.search(pattern, r["t"])) for r in rows)


def test_email_search_is_linear_and_equals_a_plain_search(spark):
    draw = random.Random(3)
    parts = ["a", "b.", "%", "2a", "@", "@b.co", "é", "-", " ", ".", "x@company.com", "\U0001f600", "_", "m", "|C", "@x.y.zz"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in registry.CUSTOM_PATTERNS["EMAIL"] + registry.BUSINESS_PATTERNS["BUSINESS_INTERNAL_EMAIL"]:
        regex, before, match = replacing(pattern)
        marked = F.regexp_replace("t", F.lit(regex), F.lit(f"{before}<{match}>"))
        assert [r[0] for r in df.select(marked).collect()] == [re.sub(pattern, lambda m: f"<{m[0]}>", t) for t in texts]
    long = spark.createDataFrame([("%2a" * 330_000 + " @",), ("%2a" * 330_000 + "@ ",)], "text string")
    assert [len(r["entities"]) for r in detect(long).select("entities").collect()] == [0, 0]


def test_spans_quote_the_original_text(spark):
    own = [registry.Recognizer("TAG", "<[^>]+>")]
    row = detect(spark.createDataFrame([("a <\ue000x> b <\ue001y>",)], "text string"), rows=own).first()
    assert [e["text"] for e in row["entities"]] == ["<\ue000x>", "<\ue001y>"]
