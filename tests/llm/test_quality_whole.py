"""Quality votes and features take the whole text in, whatever its words are like."""

import numpy as np

from maskwright.llm import quality


def test_text_without_white_space_is_read_whole():
    texts = ["字" * 64, "字" * 64 + "#%" * 300, "字" * 64 + "12" * 300]
    features = quality.Features()
    buckets, owner, _, _ = features.of([quality.pieces(t.split()) for t in texts])
    assert len({tuple(sorted(buckets[owner == i].tolist())) for i in range(3)}) == 3
    assert "".join(quality.pieces(texts[1].split())) == texts[1]
    words = ["a" * 64, "short", "b" * 65]
    assert quality.pieces(words[:2]) == words[:2]
    assert quality.pieces(words) == ["a" * 64, "short", "b" * 64, "b"]


def test_scorer_tells_texts_apart_behind_64_characters(spark):
    good = [("字" * 9 + "。") * (20 + i) for i in range(60)]
    bad = [("字" * 9 + "。") * 7 + "#%|~" * (50 + i) for i in range(60)]
    rows = list(enumerate(good + bad))
    found = quality.score_quality(spark.createDataFrame(rows, "doc_id bigint, text string"))
    score = [r["score"] for r in sorted(found.collect(), key=lambda r: r["doc_id"])]
    assert min(score[:60]) > max(score[60:])


def test_variety_of_long_texts():
    place = quality.LABELLERS.index("variety")
    few = [f"w{i % 40}" for i in range(20_000)]
    draw = np.random.default_rng(1)
    many = [f"w{i}" for i in draw.integers(0, 4000, 20_000)]
    assert quality.vote(" ".join(few), few)[place] == quality.BAD
    assert quality.vote(" ".join(many), many)[place] == quality.NOTHING
    for n in (0, 1, 51, 4999):
        assert quality.variety(many[:n]) == len(set(many[:n])) / max(n, 1)
