"""Scores of whole texts against plain loops over windows and words."""

import math
import random

import numpy as np
import pytest

from maskwright.llm import toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def word_input(net, word):
    ids, grams, counts, lead = net.parts([toxicity._clean(word)])
    vector = net.p["word"][ids[0]] if ids[0] else np.zeros(toxicity.WORD_DIM)
    chars = sum(net.p["char"][g] for g in grams) / counts[0]
    return np.concatenate([vector, chars, [lead[0]]]) @ net.p["w"] + net.p["b"]


def plain_window(net, words):
    if not words:
        return float(net.p["bias"][0])
    n, x = toxicity.HIDDEN, [word_input(net, w) for w in words]
    both = [np.zeros(2 * n) for _ in words]
    for d, u in enumerate((net.p["u0"], net.p["u1"])):
        h = np.zeros(n)
        for t in range(len(words)) if d == 0 else reversed(range(len(words))):
            own, g = x[t][d * 3 * n : (d + 1) * 3 * n], h @ u
            z = np.array([sigmoid(v) for v in own[:n] + g[:n]])
            r = np.array([sigmoid(v) for v in own[n : 2 * n] + g[n : 2 * n]])
            c = np.tanh(own[2 * n :] + r * g[2 * n :])
            h = c + z * (h - c)
            both[t][d * n : (d + 1) * n] = h
    e = [float(b @ net.p["att"]) for b in both]
    a = [math.exp(v - max(e)) for v in e]
    pooled = sum(w * b for w, b in zip(a, both)) / sum(a)
    return float(pooled @ net.p["out"] + net.p["bias"][0])


def plain_score(net, text):
    words = (text or "").encode().lower().split()
    if len(words) <= toxicity.WINDOW:
        return sigmoid(plain_window(net, words))
    starts = list(range(0, len(words) - toxicity.WINDOW, toxicity.STRIDE)) + [len(words) - toxicity.WINDOW]
    return sigmoid(max(plain_window(net, words[s : s + toxicity.WINDOW]) for s in starts))


def test_scores_equal_plain_loops(spark):
    rng = random.Random(2)
    calm = "the river runs below old stone bridges and carries leaves toward harbours".split()
    rude = "idiot idiots moronic moron trash".split()

    def text(n, bad):
        words = [rng.choice(calm) for _ in range(n)]
        if bad:
            words[rng.randrange(n)] = rng.choice(rude)
        return " ".join(words)

    labels = np.array([1, 0, 0] * 40)
    net = toxicity.train([text(rng.randint(5, 150), y) for y in labels], labels, epochs=6)
    assert net.beginnings
    texts = [text(n, n % 2) for n in (1, 2, 10, 47, 48, 49, 83, 84, 85, 120, 121, 400)]
    texts += [None, "", " \n", "!!", "MORONS, all!", "élan 東京 🙂", "word " * 48]
    net = toxicity.Net.load(net.dump())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.toxicity(df, net.dump()).collect()}
    for i, t in enumerate(texts):
        score = plain_score(net, t)
        assert found[i][0] == pytest.approx(score, abs=2e-5) and found[i][1] == (found[i][0] >= 0.5)


def test_beginnings_are_counted_by_texts():
    split = [[b"worthless", b"worthy"]] * 30 + [[b"calm", b"river"]] * 300
    found = toxicity._beginnings(split, np.array([1] * 30 + [0] * 300), least=3)
    assert found[b"wort"] > 1 and found[b"worth"] == found[b"wort"] and b"worthy" in found and found[b"rive"] < 0
    assert toxicity._beginnings([], np.zeros(0, int), 3) == {}
