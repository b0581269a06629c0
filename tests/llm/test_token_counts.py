"""Token counts against the tokenizer itself."""

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import queries, token_counts
from maskwright.llm.tables import table

SCHEMA = "doc_id bigint, text string, chunk string, pre_token int, found string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "c", 1, "f") for i, t in texts], SCHEMA)


def source(spark, name):
    return token_counts.read_tokenizer(spark, public_tokenizers.path(name))


ODD = [
    (1, None), (2, ""), (3, " \n\t  \n"), (4, "it's we'll 'twas don''t"), (5, "a <|endoftext|> b<|endoftext|>"), (6, "<|endoftext|>"),
    (7, "<|endoftext"), (8, "x" * 300_000), (9, "naïve café — “quoted” … 東京タワー 서울 العربية ١٢٣ 🙂👩‍👩‍👧 ՘࢏꟎"),
    (10, "á​ b　c\x00d"), (None, "same same"), (None, "same same"), (11, "tie"), (11, "tie"), (12, "word " * 1024), (13, "word " * 1023),
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("chunk_bytes", [20, 32_000_000])
def test_counts_equal_the_library(spark, name, chunk_bytes):
    docs = rows_of(spark, ODD).repartition(3)
    found = token_counts.count_tokens(docs, source(spark, name), limit=1024, chunk_bytes=chunk_bytes)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    expected = []
    for i, t in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(docs.limit(0), source(spark, name)).count() == 0


def test_random_unicode(spark):
    draw = np.random.default_rng(3)
    pools = [(0x20, 0x7F), (0x0, 0x250), (0x300, 0x600), (0x2000, 0x2100), (0x3000, 0x3200), (0xA000, 0xAC80), (0x10000, 0x11000), (0x1F600, 0x1F650)]
    texts = []
    for i in range(400):
        a, b = pools[draw.integers(len(pools))]
        own = [chr(c) for c in draw.integers(a, b, 20)] + list("  ab1.'s\n")
        texts.append((i, "".join(draw.choice(own, draw.integers(0, 60)))))
    found = token_counts.count_tokens(rows_of(spark, texts), source(spark, "byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {
        i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts
    }


def test_settled_blocks_are_settled(spark):
    """In the blocks that are split by a pattern the library splits alike, character by character."""
    split = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    pattern = regex.compile(token_counts.BYTE_LEVEL)
    for a, b in token_counts.SETTLED:
        for start in range(a, b + 1, 1000):
            text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} x " for c in range(start, min(start + 1000, b + 1)))
            assert [s for _, s in split(text)] == [m.span() for m in pattern.finditer(text)]


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    found = {tuple(r) for r in queries.QUERIES["op11_token_counts"](spark, sf).collect()}
    assert found == {
        (r["doc_id"], len((r["text"] or "").encode()), n, n > 1024)
        for r in docs
        for n in [len(library.encode(r["text"] or "", add_special_tokens=False).ids)]
    }


def test_many_copies(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same words again").alias("text"))
    found = token_counts.count_tokens(docs.repartition(8), source(spark, "byte_bpe_50k.json"))
    assert found.agg(F.sum("n_tokens")).first()[0] == 5000 * 4
