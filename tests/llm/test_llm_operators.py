"""Odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import (
    chat, components, decontaminate, langid, line_dedup, mixing, ngram_lm, quality, simhash, toxicity, vectors,
)

DOCS = "doc_id bigint, text string, lang string, source string, score int, __x string"
WORDS = "the old river runs below stone bridges and carries autumn leaves toward distant harbours where ships wait".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"{w}{i % 97}" for i in range(40_000) for w in ("lorem", "ipsum"))
    rows = [
        (1, "one line\ntwo lines\nthree lines\nfour", "en"), (2, "zero\none line\ntwo lines\nthree lines", "en"),
        (3, None, "en"), (4, "", None), (5, "  \n \n", "en"), (6, long, "en"), (7, long + " end", "en"),
        (8, "...", "de"), (None, "no id here", "en"), (None, None, None), (9, "tie tie tie", "en"), (9, "tie tie tie", "en"),
        (10, "tie tie tie", "fr"),
    ]
    return docs_of(spark, rows).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows_by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def test_line_dedup_removes_later_windows(odd, none):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == [*odd.columns, "__lines", "__removed"]
    by_id = {r["doc_id"]: r for r in found.collect() if r["doc_id"]}
    assert by_id[1]["text"] == "one line\ntwo lines\nthree lines\nfour"
    assert (by_id[2]["text"], by_id[2]["__removed"]) == ("zero", 3)
    assert by_id[3]["text"] is None and by_id[4]["text"] == "" and by_id[5]["text"] == "  \n \n"
    assert found.count() == odd.count()
    assert line_dedup.dedup_lines(none).count() == 0


def brute_lines(rows):
    seen, cut = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(full) - 2):
            key = tuple(lines[i] for i in full[k : k + 3])
            if key in seen:
                gone.update(full[k : k + 3])
            seen.add(key)
        cut[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return cut


def test_line_dedup_against_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c", "", "d"], draw.integers(0, 15)))) for i in range(120)]
    found = line_dedup.dedup_lines(docs_of(spark, [(i, t, "en") for i, t in rows]))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == brute_lines(rows)


def test_toxicity_odd_rows(odd, none):
    model = toxicity.train(["you idiot go away", "have a nice day"] * 30, np.array([1, 0] * 30)).dump()
    found = toxicity.toxicity(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {True}
    assert toxicity.toxicity(none, model).count() == 0


def test_toxicity_without_labels(odd, none):
    labels = odd.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert toxicity.toxicity(odd, toxicity.fit(odd, labels)).count() == odd.count()


def test_toxicity_gradients():
    net = toxicity.Net([b"a", b"b"])
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3, 5, 6 * toxicity.HIDDEN)).astype(np.float32)
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 1, 1, 0]], dtype=bool)
    logit, state = net.forward(x, mask, keep=True)
    grads, dx = net.backward(np.ones(3, np.float32), mask, state)
    for name in ("u0", "u1", "att", "out"):
        at = tuple(0 for _ in net.p[name].shape)
        net.p[name][at] += 1e-2
        up = net.forward(x, mask)[0].sum()
        net.p[name][at] -= 2e-2
        down = net.forward(x, mask)[0].sum()
        net.p[name][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(grads[name][at]), abs=2e-2)
    step = np.zeros_like(x)
    step[0, 2, 3] = 1e-2
    assert (net.forward(x + step, mask)[0] - net.forward(x - step, mask)[0]).sum() / 2e-2 == pytest.approx(float(dx[0, 2, 3]), abs=2e-2)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<", "[/", "a\n[TEXT]", "", None, "[ROLE]x[TEXT]y[/TEXT]", "\U0001f600<", "$1 \\1"]
    roles = ["user", "assistant", "system", "tool", None, "[INST]"]
    rows = [(c, t, roles[(c * 3 + t) % len(roles)], nasty[(c + t) % len(nasty)]) for c in range(12) for t in range(5)]
    rows += [(None, 0, "user", "x"), (50, None, "user", "x"), (51, 1, "user", "same"), (51, 1, "user", "same")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    reader = chat.Reader(chat.DEFAULT)
    for r in turns.collect():
        assert reader.turns(r["formatted"]) == [(r["role"], r["text"])]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    digests = chat.read_back(turns)
    assert digests.count() == 15 and digests.agg(F.sum("n_turns")).first()[0] == len(rows)
    assert chat.read_back(turns.limit(0)).count() == 0


def test_chat_order(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (3, 1, "user")]
    df = spark.createDataFrame([(c, t, r, "x") for c, t, r in rows], "conv_id bigint, turn bigint, role string, text string")
    good = {r["conv_id"]: r["in_order"] for r in chat.read_back(chat.format_turns(df)).collect()}
    assert good == {1: True, 2: False, 3: False}


def test_language(spark, odd, none):
    train = [(i, "the cat and the dog were here with that", "en") for i in range(40)]
    train += [(i, "der hund und die katze waren nicht hier", "de") for i in range(40, 80)]
    train += [(i, "собака и кошка были здесь", "ru") for i in range(80, 120)]
    model = langid.fit(docs_of(spark, train))
    assert model.languages == ["de", "en", "ru"]
    mixed = "the dog and the cat were here that der hund und die katze waren nicht кошка были"
    found = {r["doc_id"]: r for r in langid.identify(docs_of(spark, [(1, mixed, None), (2, "12 34 ...", None)]), model, spans=True).collect()}
    assert [s["lang"] for s in found[1]["spans"]] == ["en", "de", "ru"]
    assert mixed[found[1]["spans"][1]["start"] : found[1]["spans"][1]["end"]] == "der hund und die katze waren nicht"
    assert (found[2]["lang_pred"], found[2]["score"]) == ("und", 0.0)
    assert langid.identify(odd, model).count() == odd.count()
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none)
    assert empty.languages == [] and {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_viterbi_against_brute_force():
    draw = np.random.default_rng(3)
    lengths = np.array([0, 1, 5, 3, 6, 5])
    scores = draw.normal(size=(lengths.sum(), 3)) * 3
    found = langid.viterbi(scores, lengths, 2.0)
    start = 0
    for n in lengths:
        own = scores[start : start + n]
        best = max(
            (sum(own[i, c] for i, c in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])) for p in np.ndindex(*[3] * n)),
            default=0,
        )
        got = found[start : start + n]
        assert sum(own[i, c] for i, c in enumerate(got)) - 2.0 * sum(got[1:] != got[:-1]) == pytest.approx(best)
        start += n


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (None, 1), (2, 5), (20, 10), (10, 15), (15, 8)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(3, 2), (4, 2), (5, 2), (9, 8), (10, 8), (15, 8), (20, 8)}


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(30, 8))
    x = [base[i % 30] + draw.normal(scale=0.12, size=8) for i in range(300)] + [base[0]] * 4 + [3.0 * base[0]]
    rows = [(i, [float(f) for f in np.float32(v)], i % 3) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None], [float("inf")] * 8, [1.0] * 5]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[0][1], None), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("kept", F.lit(1))
    found = {r["vec_id"]: r for r in vectors.near_duplicates(df, 0.98, sample=200).collect()}
    unit = np.stack([np.float64(r[1]) / np.linalg.norm(np.float64(r[1])) for r in rows[: len(x)]])
    near = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 3 == np.arange(len(x))[None, :] % 3)
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    for i in range(len(x)):
        assert (found[i]["n_links"], found[i]["component_id"]) == (near[i].sum(), label[i]), i
        assert found[i]["kept"] == (label[i] == i)
    for i in (*range(1000, 1007), 2000):
        assert (found[i]["n_links"], found[i]["component_id"]) == (0, i)
    assert (found[None]["n_links"], found[None]["component_id"]) == (0, None)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_targets_and_flow():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}
    flows = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 12})
    got = Counter()
    for p, own in flows.items():
        got.update(own)
    assert got == {"a": 12, "b": 12} and sum(flows[("a",)].values()) <= 12
    assert sum(max(0, sum(own.values()) - n) for own, n in zip((flows[("a",)], flows[("a", "b")], flows[("b",)]), (10, 10, 2))) == 2


def test_mix(odd, none):
    found = mixing.mix(odd, F.array("source"))
    assert found.count() == odd.count()
    assert all(r["taken"] <= 2 * r["size"] for r in found.collect())
    assert rows_by_id(found, "size", "taken") == rows_by_id(mixing.mix(odd, F.array("source")), "size", "taken")
    both = mixing.mix(odd, F.when(F.col("doc_id") == 6, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))), share=1.0)
    assert {u for r in both.collect() for u in r["uses"]} <= {"a", "b"}
    assert mixing.mix(none, F.array("source")).count() == 0


def test_mix_spreads_rows_without_id(spark, monkeypatch):
    """Rows without id lie along the whole line: they are not one slot, and their words come near the target."""
    rows = spark.range(0, 20_000, 1, 8).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"),
    )
    kept = []
    own = mixing.saved
    monkeypatch.setattr(mixing, "saved", lambda df, name: kept.append((name, own(df, name))) or kept[-1][1])
    found = mixing.mix(rows, F.array("source")).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
    slots = next(df for name, df in kept if name == "sizes").groupBy("sources", "slot").count()
    assert slots.agg(F.max("count")).first()[0] < 40
    assert len(found) == 2 and all(abs(r["t"] - r["x"]) <= 4 for r in found)


def test_vectors_with_one_hot_label(spark, monkeypatch):
    """Lists follow the largest label, though a thousand others have few vectors each."""
    seen = []
    own = vectors.Quantiser
    monkeypatch.setattr(vectors, "PER_LIST", 64)
    monkeypatch.setattr(vectors, "Quantiser", lambda sample, lists, *a: seen.append(lists) or own(sample, lists, *a))
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.standard_normal(4)], "hot" if i < 500 else f"l{i % 1000}") for i in range(1500)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string"))
    got = {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert max(seen) == 8
    x = np.array([np.array(v, np.float32) for _, v, _ in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for label in {label for *_, label in rows}:
        own_rows = [i for i, r in enumerate(rows) if r[2] == label]
        near = (x[own_rows] @ x[own_rows].T >= 0.98).sum(1) - 1
        assert [got[i] for i in own_rows] == near.tolist()


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    own = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(odd, none, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 64)
    found = simhash.near_duplicates(odd)
    assert found.count() == odd.count()
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in found.collect() if r["doc_id"]}
    for i, text in texts:
        if i:
            assert prints[i] & (1 << 64) - 1 == brute_fingerprint(text), i
    by_id = {r["doc_id"]: r["component_id"] for r in found.collect() if r["doc_id"]}
    assert by_id[3] == by_id[4] == by_id[5] == 3 and by_id[10] == 9 and by_id[7] == 6
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("most", [1 << 21, 500])
def test_ball_links_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_VARIANTS", most)
    draw = np.random.default_rng(9)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    all_prints = set(base.tolist())
    for b in base[:20].tolist():
        for flips in (1, 2, 3, 4, 5, 6):
            all_prints.add(b ^ sum(1 << int(i) for i in draw.choice(64, flips, replace=False)))
    values = np.array(sorted(all_prints), dtype=np.uint64)
    signed = values.view(np.int64).tolist()
    edges = simhash.near_edges(spark.createDataFrame([(v,) for v in signed], "fingerprint bigint"))
    found = dict(zip(signed, signed))
    found |= {r["node"]: r["root"] for r in components.components(edges).collect()}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.array(signed)
    for _ in range(len(signed)):
        label = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
    assert found == dict(zip(signed, label.tolist()))


def test_leaks(spark, odd, none):
    item = " ".join(WORDS)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "x y"), (1, item)], "item_id bigint, text string")
    filler = " ".join(f"word{i}" for i in range(700))
    rows = [(1, f"{filler} {item.upper()} {filler}", "en"), (2, item.replace("bridges", "BRIDGE,"), "en"), (3, filler, "en"), (4, None, "en")]
    rows += [(5, " ".join(WORDS[:8]) + " " + filler, "en"), (1, f"{filler} {item.upper()} {filler}", "en"), (None, item, "en")]
    found = decontaminate.leaks(docs_of(spark, rows), items)
    assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=repr) == [(1, 1), (None, 1)]
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0


def test_search_retrieves_all_above_threshold():
    draw = np.random.default_rng(2)
    vocabulary = np.array([f"w{i}" for i in range(300)])
    chance = 1 / np.arange(1, 301)
    items = [(i, draw.choice(vocabulary, draw.integers(5, 60), p=chance / chance.sum()).tolist(), []) for i in range(200)]
    index = decontaminate.Index(items)
    words = [draw.choice(vocabulary, 400, p=chance / chance.sum()).tolist() for _ in range(5)] + [items[3][1] + items[9][1]]
    numbers = np.array([index.vocabulary.get(w, -1) for x in words for w in x])
    passage, term, text, first = decontaminate.passages(numbers, np.array([len(x) for x in words]))
    got = {(p, e): s for p, e, s in zip(*(x.tolist() for x in index.search(passage, term, 0.4)))}
    expected = {}
    for p in range(len(text)):
        own = set(words[text[p]][first[p] : first[p] + decontaminate.PASSAGE])
        assert {index.vocabulary[w] for w in own if w in index.vocabulary} == set(term[passage == p].tolist())
        score = np.zeros(len(index.item_of))
        rows = np.isin(np.repeat(index.key // index.blocks, np.diff(index.starts)), [index.vocabulary.get(w, -1) for w in own])
        np.add.at(score, index.entry[rows], index.weight[rows])
        expected |= {(p, int(e)): score[e] for e in np.flatnonzero(score >= 0.4)}
    assert got.keys() == expected.keys() and got == pytest.approx(expected)


def test_quality(spark, odd, none):
    good = [(i, " ".join(np.random.default_rng(i).permutation(WORDS)) + ". And then it ended.", "en") for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in np.random.default_rng(i).permutation(WORDS)), "en") for i in range(20)]
    found = {r["doc_id"]: r for r in quality.score_quality(docs_of(spark, good + bad)).collect()}
    assert all(found[i]["predicted"] == 1 for i in range(60)) and all(found[100 + i]["predicted"] == 0 for i in range(20))
    rows = quality.score_quality(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert quality.score_quality(none).count() == 0


def test_label_model_finds_accuracies():
    draw = np.random.default_rng(4)
    truth = draw.random(20_000) < 0.8
    right = np.linspace(0.6, 0.95, len(quality.LABELLERS))
    votes = np.where(draw.random((len(truth), len(right))) < right, truth[:, None], ~truth[:, None]) * 2
    votes = np.where(draw.random(votes.shape) < 0.3, quality.NOTHING, votes)
    codes, place, counts = np.unique([quality.pattern(v) for v in votes], return_inverse=True, return_counts=True)
    good, table = quality.estimate(codes, counts)
    assert ((good[place] > 0.5) == truth).mean() > 0.97
    assert table[:, 1, quality.GOOD] / (1 - table[:, 1, quality.NOTHING]) == pytest.approx(right, abs=0.03)


def brute_backoff(texts):
    words = [(t or "").split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        s = 0.0
        for i in range(len(w)):
            for skipped, n in enumerate(range(min(3, i + 1), 0, -1)):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[gram] >= 2:
                    s += np.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total)) + skipped * np.log(0.4)
                    break
        out.append(s)
    return out


def test_backoff_against_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 50_000)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    scores = brute_backoff([t for _, t in rows])
    found = ngram_lm.backoff_scores(odd).collect()
    assert sorted(r["log_score"] for r in found) == pytest.approx(sorted(scores))
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in found)
    assert ngram_lm.backoff_scores(none).count() == 0


def test_backoff_of_equal_rows_is_spread(spark, monkeypatch):
    """Rows without id and with equal texts are many chunks, in many tasks."""
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 200_000)
    sizes = []
    kept = ngram_lm.saved_in_buckets
    monkeypatch.setattr(ngram_lm, "saved_in_buckets", lambda *a: sizes.append(kept(*a)) or sizes[-1])
    rows = spark.range(0, 100_000, 1, 16).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same words here").alias("text"))
    found = ngram_lm.backoff_scores(rows).groupBy("n_words", F.round("log_score", 9).alias("s")).count().collect()
    assert [(r["n_words"], r["count"], r["s"]) for r in found] == [(3, 100_000, round(float(np.log(1 / 3)), 9))]
    by_size = sizes[0].agg(F.count("*"), F.max(F.size("doc_ids"))).first()
    assert by_size[0] >= 64 and by_size[1] < 2000


def test_packing():
    for values in ([], [0], [1, 2, 255], [256, 0, 1 << 40]):
        x = np.array(values, dtype=np.uint64)
        assert ngram_lm.unpack(ngram_lm.pack(x), len(x)).tolist() == values
