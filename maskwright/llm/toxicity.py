"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input joins a learned vector of the word (for words frequent in training), whose first
entry starts as the evidence of the word's counts by class, the mean of learned vectors of its
character trigrams, and the strongest evidence of its first characters, which words of one stem share.
The network reads overlapping windows of words in both
directions, pools its states by attention, and scores each window; a text scores as its most toxic
window. It is trained in numpy by one task, on a bounded sample of labelled texts; scoring is
map-only.
"""

from __future__ import annotations

import io
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import slices, type_of

WINDOW, STRIDE = 48, 36
HIDDEN, WORD_DIM, CHAR_DIM = 12, 8, 8
CHAR_BUCKETS = 1 << 13
CHANCE = 4.0
EXTRA, SPREAD = 1, 4.0
DROPPED = 0.1
DECAY, MOST_DECAY = 12.0, 0.04  # word vectors shrink by DECAY / toxic texts of a step, at most
VOCABULARY, MIN_TEXTS, MIN_SHARE = 20_000, 3, 0.005
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of a word's beginning that evidence is counted for
WORDS_KEPT = 300_000  # word types whose inputs a task remembers
WINDOWS_AT_ONCE = 2048


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: a fifth, and those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _clean(word: bytes) -> bytes:
    return word.strip(string.punctuation.encode()) or word


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' character trigrams, and how many each word has (one at least)."""
    marked = [b"<" + w + b">" + b" " * (len(w) == 0) for w in words]
    lengths = np.array([len(m) for m in marked])
    codes = np.frombuffer(b"".join(marked) + b"  ", dtype=np.uint8).astype(np.uint32)
    grams = (codes[:-2] * 8191 + codes[1:-1] * 127 + codes[2:]) * np.uint32(2654435761) >> np.uint32(19)
    ends = np.cumsum(lengths)
    keep = np.ones(len(grams), dtype=bool)
    keep[ends - 1] = keep[ends - 2] = False
    return grams[keep].astype(np.int64) % CHAR_BUCKETS, lengths - 2


class Net:
    """Parameters, word inputs, and both passes of the network."""

    def __init__(self, vocabulary: list[bytes], seed: int = 7):
        draw = np.random.default_rng(seed)
        at = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.beginnings: dict[bytes, float] = {}
        inputs = WORD_DIM + CHAR_DIM + 1
        self.p = {
            "word": at(len(vocabulary) + 1, WORD_DIM, scale=0.1),
            "char": at(CHAR_BUCKETS, CHAR_DIM, scale=0.1),
            "w": at(inputs, 6 * HIDDEN, scale=0.3),
            "b": np.zeros(6 * HIDDEN, np.float32),
            "u0": at(HIDDEN, 3 * HIDDEN, scale=0.2),
            "u1": at(HIDDEN, 3 * HIDDEN, scale=0.2),
            "att": at(2 * HIDDEN, scale=0.2),
            "out": at(2 * HIDDEN, scale=0.2),
            "bias": np.zeros(1, np.float32),
        }

    def dump(self) -> bytes:
        words = np.array(list(self.vocabulary), dtype=object)
        out = io.BytesIO()
        lists = {"vocabulary": words.tolist(), "beginnings": list(self.beginnings)}
        texts = {k: np.frombuffer(b"\n".join(v), dtype=np.uint8) for k, v in lists.items()}
        np.savez(out, **texts, evidence=np.array(list(self.beginnings.values())), **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Net:
        stored = dict(np.load(io.BytesIO(blob)))
        words, begin = ([w for w in stored.pop(k).tobytes().split(b"\n") if w] for k in ("vocabulary", "beginnings"))
        net = cls(words)
        net.beginnings = dict(zip(begin, stored.pop("evidence").tolist()))
        net.p = stored
        return net

    def parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary numbers, trigram buckets, trigram counts and evidence of the beginnings of cleaned words."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        known = self.beginnings.get
        lead = np.array([max((known(w[:n], 0.0) for n in BEGINNINGS), key=abs) for w in words], dtype=np.float32)
        return ids, *_trigrams(words), lead

    def embed(self, ids: np.ndarray, grams: np.ndarray, counts: np.ndarray, lead: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][grams], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        return np.concatenate([self.p["word"][ids] * (ids > 0)[:, None], chars, lead[:, None]], axis=1).astype(np.float32)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return self.embed(*self.parts(words)) @ self.p["w"] + self.p["b"]

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple:
        """x: windows x words x gate inputs of both directions. Window logits (and what backward needs)."""
        n, steps, _ = x.shape
        states = np.zeros((2, steps + 1, n, HIDDEN), np.float32)
        kept: list[list] = [[None] * steps, [None] * steps]
        for d, u in ((0, self.p["u0"]), (1, self.p["u1"])):
            own = x[:, :, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN]
            h = states[d, 0]
            for s in range(steps):
                t = s if d == 0 else steps - 1 - s
                g, xt = h @ u, own[:, t]
                zr = 1 / (1 + np.exp(-(xt[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(xt[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    kept[d][s] = (h, z, r, c, g)
                h = states[d, s + 1] = new
        both = np.concatenate([states[0, 1:], states[1, 1:][::-1]], axis=2)  # words x windows x 2H
        e = both @ self.p["att"]
        if mask is not None:
            e = np.where(mask.T, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, both)
        if mask is not None:
            pooled *= mask.any(axis=1)[:, None]
        return pooled @ self.p["out"] + self.p["bias"][0], (both, a, pooled, kept)

    def backward(self, d_logit: np.ndarray, mask: np.ndarray, state: tuple) -> tuple[dict, np.ndarray]:
        both, a, pooled, kept = state
        steps, n, _ = both.shape
        grads = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["out"] * mask.any(axis=1)[:, None]
        d_a = np.einsum("nh,tnh->tn", d_pooled, both)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        grads["att"] = np.einsum("tn,tnh->h", d_e, both)
        d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["att"]
        dx = np.zeros((n, steps, 6 * HIDDEN), np.float32)
        for d, name in ((0, "u0"), (1, "u1")):
            u, du = self.p[name], np.zeros_like(self.p[name])
            dh = np.zeros((n, HIDDEN), np.float32)
            for s in range(steps - 1, -1, -1):
                t = s if d == 0 else steps - 1 - s
                h, z, r, c, g = kept[d][s]
                dh = dh + d_both[t][:, d * HIDDEN : (d + 1) * HIDDEN]
                on = mask[:, t, None]
                dn = dh * on
                dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * g[:, 2 * HIDDEN :] * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                dx[:, t, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN] = np.concatenate([dz, dr, dc], axis=1)
                du += h.T @ dg
                dh = dh * ~on + dn * z + dg @ u.T
            grads[name] = du
        return grads, dx


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and number of words of all windows; a text has one at least."""
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), more + 1)
    k = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    first = np.minimum(k * STRIDE, np.maximum(lengths[text] - WINDOW, 0))
    return text, first, np.minimum(lengths[text], WINDOW)


class Numbers(dict):
    """Numbers words from 1 as they come, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        self.new.append(word)
        return number


class Reader:
    """Turns texts into rows of word numbers, and keeps the inputs of the words it has seen."""

    def __init__(self, net: Net):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.rows = np.zeros((1 << 16, 6 * HIDDEN), np.float32)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words in order, and the number of words of each text."""
        split = [t.encode("utf-8", "replace").lower().split() for t in texts]
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        if len(self.known) > WORDS_KEPT:
            self.forget()
        known = self.known
        out: list[int] = []
        for words in split:
            out += map(known.__getitem__, words)
        new, known.new = known.new, []
        while len(known) >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            first = len(known) - len(new) + start + 1
            self.rows[first : first + len(part)] = self.net.inputs([_clean(w) for w in part])
        return np.array(out, dtype=np.int32), lengths

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each text."""
        words, lengths = self.numbers(texts)
        text, first, size = _windows(lengths)
        begin = (np.cumsum(lengths) - lengths)[text] + first
        out = np.full(len(texts), -np.inf)
        words = np.append(words, np.zeros(WINDOW, np.int32))
        for full in (True, False):
            those = np.flatnonzero((size == WINDOW) == full)
            for start in range(0, len(those), WINDOWS_AT_ONCE):
                w = those[start : start + WINDOWS_AT_ONCE]
                steps = WINDOW if full else max(1, int(size[w].max()))
                mask = None if full else np.arange(steps) < size[w][:, None]
                x = self.rows[words[begin[w][:, None] + np.arange(steps)]]
                np.maximum.at(out, text[w], self.net.forward(x, mask)[0])
        return out


def _evidence(with_word: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How surely a word goes with toxic texts: the signed root of the likelihood ratio of its text
    counts by class (columns: other, toxic), of which only what chance hardly gives counts."""
    total = with_word.sum(axis=1, keepdims=True)
    expected = total * texts / texts.sum()
    log = lambda a, b: a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9))
    ratio = 2 * (log(with_word, expected) + log(texts - with_word, texts - expected)).sum(axis=1)
    root = np.sqrt(np.maximum(ratio, 0))
    return np.sign(with_word[:, 1] - expected[:, 1]) * np.minimum(np.maximum(root - CHANCE, 0), 8) / 4


def _beginnings(split: list[list[bytes]], labels: np.ndarray, least: float) -> dict[bytes, float]:
    """Evidence of beginnings of words, counted by texts; those that say nothing are left out."""
    with_it: list[Counter] = [Counter(), Counter()]
    for words, label in zip(split, labels):
        with_it[label].update({w[:n] for w in set(words) for n in BEGINNINGS if len(w) >= n})
    names = sorted(b for b in with_it[0].keys() | with_it[1].keys() if with_it[0][b] + with_it[1][b] >= least)
    if not names:
        return {}
    found = _evidence(np.array([[c[b] for c in with_it] for b in names], dtype=float), np.bincount(labels, minlength=2))
    return {b: float(x) for b, x in zip(names, found) if x}


def train(texts: list[str], labels: np.ndarray, epochs: int = 14, seed: int = 7) -> Net:
    """Fit on texts labelled 0 or 1; of each text, the window that scores highest is learned from."""
    split = [[_clean(w) for w in t.encode("utf-8", "replace").lower().split()] for t in texts]
    seen = Counter(w for words in split for w in words)
    spread = Counter(w for words in split for w in set(words))
    least = max(MIN_TEXTS, MIN_SHARE * len(texts))
    net = Net([w for w, n in sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= least], seed)
    by_class = np.zeros((len(net.vocabulary) + 1, 2))
    for own, label in zip(split, labels):
        by_class[[i for i in {net.vocabulary.get(w, 0) for w in own} if i], label] += 1
    net.p["word"][:, 0] = _evidence(by_class, np.bincount(labels, minlength=2))
    net.beginnings = _beginnings(split, labels, least)
    types = {w: i for i, w in enumerate(seen)}
    if not types:
        return net
    ids, grams, counts, lead = net.parts(list(types))
    gram_starts = np.cumsum(counts) - counts
    words = np.array([types[w] for s in split for w in s], dtype=np.int64)
    lengths = np.array([len(s) for s in split])
    text, first, size = _windows(lengths)
    begin = (np.cumsum(lengths) - lengths)[text] + first
    words = np.append(words, np.zeros(WINDOW, np.int64))
    steps = np.arange(WINDOW)
    draw = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    done, decay = 0, min(MOST_DECAY, DECAY / max(int(labels.sum()), 1))
    # Windows of the other class are many more than its texts: fewer toxic texts count for more.
    rarer = float(np.clip(np.sqrt((labels == 0).sum() / max(int(labels.sum()), 1)), 1, 3))
    per_batch = int(np.clip(len(texts) // 12, 8, 96))
    epochs = max(epochs, min(30, 14 * 1200 // max(len(texts), 1)))
    signs = np.concatenate([[0.0], np.cumsum(np.abs(net.p["word"][ids[words], 0]) + np.abs(lead[words]))])
    for epoch in range(epochs):
        score = signs[begin + size] - signs[begin] + 0.01 * draw.random(len(text))
        if epoch > 1:
            rows = net.embed(ids, grams, counts, lead) @ net.p["w"] + net.p["b"]
            for start in range(0, len(text), WINDOWS_AT_ONCE):
                w = slice(start, start + WINDOWS_AT_ONCE)
                score[w] = net.forward(rows[words[begin[w][:, None] + steps]], steps < size[w][:, None])[0]
        order = np.lexsort((score, text))
        best = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
        others = np.flatnonzero(labels[text] == 0)  # and more windows of texts that are not toxic
        more = others[np.argsort(-score[others] + draw.exponential(SPREAD, len(others)))[: EXTRA * len(best)]]
        chosen = draw.permutation(np.unique(np.concatenate([best, more])))
        for start in range(0, len(chosen), per_batch):
            w = chosen[start : start + per_batch]
            mask = steps < size[w][:, None]
            at = words[begin[w][:, None] + steps]
            own, place = np.unique(at, return_inverse=True)
            own_counts = counts[own]
            own_grams = grams[np.repeat(gram_starts[own] - (np.cumsum(own_counts) - own_counts), own_counts) + np.arange(own_counts.sum())]
            e = net.embed(ids[own], own_grams, own_counts, lead[own])
            mask &= draw.random(mask.shape) >= DROPPED
            logit, state = net.forward((e @ net.p["w"] + net.p["b"])[place.reshape(at.shape)], mask, keep=True)
            target = labels[text[w]]
            d_logit = ((_sigmoid(logit) - target) * np.where(target == 1, rarer, 1.0) / len(w)).astype(np.float32)
            grads, dx = net.backward(d_logit, mask, state)
            flat = dx.reshape(-1, dx.shape[2]) * mask.reshape(-1, 1)
            by_type = np.zeros((len(own), dx.shape[2]), np.float32)
            np.add.at(by_type, place.ravel(), flat)
            grads["w"], grads["b"] = e.T @ by_type, by_type.sum(axis=0)
            d_embed = by_type @ net.p["w"].T
            grads["word"] = np.zeros_like(net.p["word"])
            np.add.at(grads["word"], ids[own], d_embed[:, :WORD_DIM] * (ids[own] > 0)[:, None])
            grads["char"] = np.zeros_like(net.p["char"])
            np.add.at(grads["char"], own_grams, np.repeat(d_embed[:, WORD_DIM : WORD_DIM + CHAR_DIM] / own_counts[:, None], own_counts, axis=0))
            done += 1
            for k, g in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                rate = 0.01 * np.sqrt(1 - 0.99**done) / (1 - 0.9**done)
                net.p[k] -= (rate * m / (np.sqrt(v) + 1e-7) + (decay * net.p[k] if k in ("word", "char") else 0)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, train_chars: int = 16_384, seed: int = 7) -> bytes:
    """Train on at most ``per_class`` labelled texts of each class, none over ``train_chars``.

    The sample takes the labels that come first by a hash of the id; ids with several labels count
    as toxic if one says so. Rows with a null id, label or text, and held-out ids, are not used.
    Without a usable label the network stays as it was drawn. ``labels`` needs doc_id and toxic.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    parts = [known.filter(F.col("__toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows
    sample = docs.select("doc_id", "text").filter(F.length("text") <= train_chars).join(chosen, "doc_id")
    ordered = sample.select("text", "__toxic", F.xxhash64("doc_id").alias("h")).dropDuplicates().orderBy("h", "text").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        net = train([t for t, _ in rows], np.array([y for _, y in rows], dtype=np.int64), seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([net.dump()])], ["model"])

    found = ordered.select("text", "__toxic").mapInArrow(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else Net([], seed).dump()


def toxicity(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: the score is that of the worst window.

    Null, empty and blank texts get the network's score for no input. Repeated rows stay; an empty
    table gives no rows; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Net.load(model))
        for batch in batches:
            for part in slices(batch, max_bytes=2_000_000):
                logits = reader.logits([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sigmoid(logits))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
