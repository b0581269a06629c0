"""Quality of texts from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation
over the counts of vote patterns of all texts estimates how often each labeller is right, and so the
probability of good for each pattern. With these as labels, a hashed linear scorer of word shapes is
trained on a bounded sample; scoring is map-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import slices, type_of

BUCKETS = 1 << 16
WORDS_KEPT = 300_000
PIECE = 64  # longer words become several
STRETCH = 5000  # words over which variety is taken, fewer than that
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
MARKS = set(SYMBOLS.decode())
LABELLERS = (
    "capitals", "exclamations", "symbols", "marked_words", "letters", "repeated_words", "variety", "bars",
    "lone_marks", "repeated_lines", "clean", "sentences",
)
BAD, NOTHING, GOOD = 0, 1, 2


def pieces(words: list[str]) -> list[str]:
    """The words, those of more than PIECE characters cut into consecutive pieces."""
    if all(len(w) <= PIECE for w in words):
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def variety(words: list[str]) -> float:
    """Share of different words: the mean over equal stretches of the text, each under STRETCH words."""
    n = -(-len(words) // (STRETCH - 1))
    cuts = [len(words) * i // n for i in range(n + 1)] if n else []
    return sum(len(set(words[a:b])) for a, b in zip(cuts, cuts[1:])) / max(len(words), 1)


def vote(text: str, words: list[str]) -> list[int]:
    """Each labeller's vote on a text. Thresholds are shares of letters, characters, words or lines."""
    raw = text.encode("utf-8", "replace")
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, other = int(n[65:91].sum()), int(n[97:123].sum()), int(n[128:].sum())
    solid = max(len(raw) - int(n[[9, 10, 11, 12, 13, 32]].sum()), 1)
    count = max(len(words), 1)
    letters = (upper + lower + other) / solid
    symbols = int(n[list(SYMBOLS)].sum()) / solid
    capitals = upper / max(upper + lower, 1)
    repeated = sum(map(eq, words, words[1:])) / count
    lines = [x for x in text.split("\n") if x.strip()]
    stops = int(n[46] + n[63]) / count
    bad = {
        "capitals": capitals > 0.5 and upper + lower > 20,
        "exclamations": n[33] / count > 0.3,
        "symbols": symbols > 0.06,
        "marked_words": sum(w[-1] in MARKS for w in words) / count > 0.3,
        "letters": letters < 0.8 and solid > 40,
        "repeated_words": repeated > 0.2,
        "variety": len(words) > 50 and variety(words) < 0.2,
        "bars": n[124] / count > 0.1,
        "lone_marks": sum(len(w) == 1 and not w.isalnum() for w in words) / count > 0.1,
        "repeated_lines": len(lines) > 5 and len(set(lines)) < 0.5 * len(lines),
        "clean": False,
        "sentences": len(words) > 30 and not 0.01 < stops < 0.6,
    }
    good = {
        "clean": (letters > 0.9 or solid <= 40) and (capitals < 0.3 or upper + lower <= 20) and repeated < 0.1,
        "sentences": 0.01 < stops < 0.6 and letters > 0.85,
    }
    return [BAD if bad[x] else GOOD if good.get(x) else NOTHING for x in LABELLERS]


def pattern(votes: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


def votes_of(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(len(LABELLERS))], axis=-1)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each vote pattern, and P(vote | class) of each labeller.

    Starts from the majority of votes (ties: even), and assumes labellers independent given the class.
    """
    votes = votes_of(codes)
    lead = (votes == GOOD).sum(axis=1) - (votes == BAD).sum(axis=1)
    good = np.clip(0.5 + 0.15 * lead, 0.05, 0.95)
    table = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        for j in range(len(LABELLERS)):
            for y in (0, 1):
                seen = np.bincount(votes[:, j], weights=weight[y], minlength=3) + np.array([[2, 1, 0.5], [0.5, 1, 2]][y])
                table[j, y] = seen / seen.sum()
        logs = np.log(prior)[None, :] + sum(np.log(table[j][:, votes[:, j]]).T for j in range(len(LABELLERS)))
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return good, table


class _Numbers(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def _shape(word: str) -> str:
    """The kinds of a word's characters, runs shortened, and its length up to 12."""
    out: list[str] = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out) + str(min(len(word), 12))


class Features:
    """Hashed features of texts: shapes of words, and of pairs of words with whether they are equal.

    Words come as ``pieces``, so that a text without white space counts as a whole."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.shapes = np.zeros(1 << 14, dtype=np.uint64)

    def of(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and texts of all words, then of all pairs."""
        from xxhash import xxh32_intdigest

        if len(self.known) > WORDS_KEPT:
            self.forget()
        numbers: list[int] = []
        for own in words:
            numbers += map(self.known.__getitem__, own)
        new, self.known.new = self.known.new, []
        while len(self.known) > len(self.shapes):
            self.shapes = np.concatenate([self.shapes, np.zeros_like(self.shapes)])
        self.shapes[len(self.known) - len(new) : len(self.known)] = [xxh32_intdigest(_shape(w)) for w in new]
        place = np.array(numbers, dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        shape = self.shapes[place]
        inside = owner[1:] == owner[:-1]
        same = (place[1:] == place[:-1]).astype(np.uint64)
        pair = (shape[:-1] * np.uint64(0x9E3779B1) + shape[1:] * np.uint64(0x85EBCA77) + same * np.uint64(0xC2B2AE3D)) >> np.uint64(7)
        return (shape % np.uint64(BUCKETS)).astype(np.int64), owner, (pair[inside] % np.uint64(BUCKETS)).astype(np.int64), owner[1:][inside]


def _means(weights: np.ndarray, features: tuple, n: int) -> np.ndarray:
    one, owner, two, pair_owner = features
    sums = np.bincount(owner, weights=weights[0][one], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    return sums + np.bincount(pair_owner, weights=weights[1][two], minlength=n) / np.maximum(np.bincount(pair_owner, minlength=n), 1)


def train(words: list[list[str]], labels: np.ndarray, epochs: int = 12, batch: int = 64, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over mean features, by AdaGrad on soft labels."""
    weights, seen = np.zeros((2, BUCKETS)), np.full((2, BUCKETS), 1e-8)
    bias, draw, features = 0.0, np.random.default_rng(seed), Features()
    rarity = np.where(labels < 0.5, 0.5 / max((labels < 0.5).mean(), 0.02), 0.5 / max((labels >= 0.5).mean(), 0.02))
    for _ in range(epochs):
        order = draw.permutation(len(words))
        for start in range(0, len(order), batch):
            own = order[start : start + batch]
            f = features.of([words[i] for i in own])
            p = 1 / (1 + np.exp(-np.clip(_means(weights, f, len(own)) + bias, -30, 30)))
            error = (p - labels[own]) * rarity[own] / len(own)
            for k, (bucket, owner) in enumerate(((f[0], f[1]), (f[2], f[3]))):
                size = np.maximum(np.bincount(owner, minlength=len(own)), 1)
                gradient = np.bincount(bucket, weights=(error / size)[owner], minlength=BUCKETS)
                seen[k] += gradient**2
                weights[k] -= 0.5 * gradient / np.sqrt(seen[k])
            bias -= 0.5 * error.sum()
    return weights, bias


def score_quality(docs: DataFrame, sample: int = 6000, train_chars: int = 16_384) -> DataFrame:
    """(doc_id, score, predicted, posterior) of every row: the scorer's probability that the text is
    good, 1 where it is at least 0.5, and the weak labels' own probability.

    Vote patterns are counted over all rows; the scorer learns from about ``sample`` texts of at
    most ``train_chars``, chosen by a hash of the text. Its words are runs of anything but white
    space; a longer run than 64 characters counts as several words. Null, empty and blank texts score 0. Repeated
    rows stay; an empty table gives no rows; extra columns are not read.
    """

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                codes, n = np.unique([pattern(vote(t, t.split())) for t in texts], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    counted = docs.select("text").mapInArrow(patterns, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    rows = sorted((r["code"], r["n"]) for r in counted.collect())  # at most 3 patterns per labeller, multiplied
    codes = np.array([r[0] for r in rows], dtype=np.int64)
    counts = np.array([r[1] for r in rows], dtype=np.float64)
    posterior = dict(zip(codes.tolist(), estimate(codes, counts)[0].tolist())) if len(rows) else {}
    share = int(min(1.0, sample / max(counts.sum(), 1)) * (1 << 30))
    chosen = docs.select("text").filter((F.length("text") <= train_chars) & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(0).to_pylist()]
        words = [t.split() for t in texts]
        labels = np.array([posterior[pattern(vote(t, w))] for t, w in zip(texts, words)])
        weights, bias = train([pieces(w) for w in words], labels) if texts else (np.zeros((2, BUCKETS)), 0.0)
        blob = np.append(weights.ravel(), bias).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([blob])], ["model"])

    learned = chosen.distinct().repartition(1).sortWithinPartitions("text").mapInArrow(learn, "model binary").collect()
    model = np.frombuffer(learned[0]["model"], dtype=np.float32).astype(np.float64) if learned else np.zeros(2 * BUCKETS + 1)
    weights, bias = model[:-1].reshape(2, BUCKETS), float(model[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                words = [t.split() for t in texts]
                value = _means(weights, features.of([pieces(w) for w in words]), len(texts)) + bias
                some = np.array([len(w) > 0 for w in words])
                score = np.where(some, 1 / (1 + np.exp(-np.clip(value, -30, 30))), 0.0)
                weak = [posterior.get(pattern(vote(t, w)), 0.5) for t, w in zip(texts, words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(weak)], ["doc_id", "score", "posterior"])

    kind = type_of(docs, "doc_id")
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, posterior double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "posterior")
