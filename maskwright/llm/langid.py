"""Languages of texts: script ranges narrow the candidates of each word, and Viterbi over per-word
scores with a penalty for switching labels the spans of mixed-language texts.

A word's score for a language sums the log-probabilities of its character n-grams. Words of a
script that only some languages use can only be labelled with those. Training counts n-grams over a
bounded sample per language; labelling is map-only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import slices, type_of

BUCKETS = 1 << 16
ORDERS = 3
WORDS_KEPT = 400_000
SCRIPT_SHARE = 0.01  # a language uses a script if so much of its words are in it
WORST = 12.0  # how much one word can speak against a language
LAST_CODE = 0x10FFFF

# First code points of script ranges (Unicode blocks), and the script of each.
SCRIPTS = (
    "none latin greek cyrillic armenian hebrew arabic indic thai lao tibetan myanmar georgian hangul ethiopic "
    "khmer mongolian kana han other"
).split()
RANGES = [
    (0x0000, "none"), (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA4D0, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
RANGE_STARTS = np.array([a for a, _ in RANGES])
RANGE_SCRIPTS = np.array([SCRIPTS.index(s) for _, s in RANGES])
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: a quarter, and those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def _letters(token: str) -> str:
    return token if token.isalpha() else " ".join(LETTERS.findall(token))


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words (letters only, perhaps none): bucket of every character n-gram up to ORDERS, the
    word each belongs to, and each word's script and number of letters."""
    marked = [f" {w} " for w in words]
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    gram = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        gram = gram[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        inside = owner[: len(gram)] == owner[n - 1 :]
        if n == 1:
            inside &= codes != 32
        mixed = gram[inside] * np.uint32(2654435761)
        buckets.append((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(16))
        owners.append(owner[: len(gram)][inside])
    script = RANGE_SCRIPTS[np.searchsorted(RANGE_STARTS, codes, "right") - 1]
    letter = codes != 32
    by_word = np.bincount(owner[letter] * len(SCRIPTS) + script[letter], minlength=len(words) * len(SCRIPTS))
    by_word = by_word.reshape(len(words), len(SCRIPTS))
    buckets, owners = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    real = by_word.sum(axis=1)[owners] > 0
    return buckets[real], owners[real], by_word.argmax(axis=1), by_word.sum(axis=1)


@dataclass
class Model:
    """log_probs: languages x buckets; allowed: scripts x languages; used: scripts that some language
    uses; typical, spread: mean and deviation of an n-gram's log-probability in a language's own sample."""

    languages: list[str]
    log_probs: np.ndarray
    allowed: np.ndarray
    used: np.ndarray
    typical: np.ndarray
    spread: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (0 for the best language, below it for others) and letters of each word."""
        scores, letters, *_ = self.word_fits(words)
        return scores, letters

    def word_fits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``word_scores``, and of each word the sums of log-probabilities per language, the number of
        its n-grams, and its letters if some language uses its script (else 0)."""
        buckets, owners, script, letters = word_grams(words)
        out = np.zeros((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owners, weights=self.log_probs[k, buckets], minlength=len(words))
        sums, grams = out, np.bincount(owners, minlength=len(words))
        open_to = self.allowed[script]
        out = np.where(open_to, out, -np.inf)
        out = np.maximum(out - out.max(axis=1, keepdims=True), -WORST)
        out[~open_to] = -4 * WORST
        out[letters == 0] = 0
        return out, letters, sums, grams, np.where(self.used[script], letters, 0)


def fit(docs: DataFrame, per_language: int = 1500, train_chars: int = 16_384) -> Model:
    """Learn from about ``per_language`` texts of each non-null lang, none over ``train_chars``,
    that come first by a hash of the id. Held-out and null ids and null texts are not used."""
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= train_chars)
    )
    # One number per language: nothing beside the model, which has tens of thousands for each.
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair]), F.col("lang")) if sizes else F.lit(0)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = usable.filter(place * size < per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = found.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                words = [_letters(w) for w in text.lower().split()]
                buckets, _, script, letters = word_grams(words) if words else (np.zeros(0, np.int64),) * 4
                own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(script[letters > 0], minlength=len(SCRIPTS))
        for lang, own in found.items():
            some = np.flatnonzero(own)
            arrays = [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found, bucket, n = (rows.column(c).to_pylist() for c in ("lang", "bucket", "n"))
    languages = sorted(set(found))
    number = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    counts[[number[x] for x in found], bucket] = n
    grams, scripts = counts[:, :BUCKETS] + 0.1, counts[:, BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    allowed = (share >= SCRIPT_SHARE).T
    used = allowed.any(axis=1)
    allowed[~used] = True
    log_probs = np.log(grams / grams.sum(axis=1, keepdims=True))
    weight = counts[:, :BUCKETS] / np.maximum(counts[:, :BUCKETS].sum(axis=1, keepdims=True), 1)
    typical = (weight * log_probs).sum(axis=1)
    spread = np.sqrt(np.maximum((weight * log_probs**2).sum(axis=1) - typical**2, 0))
    return Model(languages, log_probs, allowed, used, typical, spread)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of several sequences of rows of ``scores`` when each change costs ``penalty``.

    All sequences advance together, the longest first; ties stay with the label, then take the first.
    """
    out = np.zeros(len(scores), dtype=np.int32)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    jumps = np.zeros(scores.shape, dtype=bool)
    origin = np.zeros(len(scores), dtype=np.int32)
    v = np.zeros((len(lengths), scores.shape[1]))
    for t, k in enumerate(active):
        at = begin[:k] + t
        own = v[:k]
        if t:
            best = own.argmax(axis=1)
            reach = own[np.arange(k), best][:, None] - penalty
            jump = reach > own
            jumps[at], origin[at] = jump, best
            own = np.where(jump, reach, own)
            own -= own.max(axis=1, keepdims=True)
        v[:k] = own + scores[at]
    label = v.argmax(axis=1).astype(np.int32) if v.size else np.zeros(len(v), np.int32)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at, own = begin[:k] + t, label[:k]
        out[at] = own
        label[:k] = np.where(jumps[at, own], origin[at], own)
    return out


class _Words(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Labeller:
    def __init__(self, model: Model, penalty: float, fitness: bool = False):
        self.model, self.penalty, self.fitness = model, penalty, fitness
        self.forget()

    def forget(self) -> None:
        self.known = _Words()
        self.scores = np.zeros((1 << 15, len(self.model.languages)))
        self.letters = np.zeros(1 << 15, dtype=np.int64)
        # What ``fits`` needs of each word: how much likelier than typical, n-grams, letters of a used script.
        self.excess = np.zeros((len(self.scores) * self.fitness, len(self.model.languages)), dtype=np.float32)
        self.grams = np.zeros((len(self.excess), 2), dtype=np.int64)

    def label(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels and letters of all tokens in order, and the number of tokens of each text."""
        if len(self.known) > WORDS_KEPT:
            self.forget()
        numbers: list[int] = []
        for own in tokens:
            numbers += map(self.known.__getitem__, own)
        new, self.known.new = self.known.new, []
        while len(self.known) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.excess = np.concatenate([self.excess, np.zeros_like(self.excess)])
            self.grams = np.concatenate([self.grams, np.zeros_like(self.grams)])
        for i in range(0, len(new), 50_000):
            first = len(self.known) - len(new) + i
            scores, letters, sums, grams, used = self.model.word_fits([_letters(w) for w in new[i : i + 50_000]])
            self.scores[first : first + len(letters)] = scores
            self.letters[first : first + len(letters)] = letters
            if self.fitness:
                self.excess[first : first + len(letters)] = sums - grams[:, None] * self.model.typical
                self.grams[first : first + len(letters)] = np.stack([grams, used], axis=1)
        self.place = place = np.array(numbers, dtype=np.int64)
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        return viterbi(self.scores[place], lengths, self.penalty), self.letters[place], lengths


    def fits(self, labels: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text labelled last: the deviations by which its n-grams are likelier in its words'
        languages than those of their samples (below 0: less likely), and its letters of used scripts."""
        by = np.bincount(owner, weights=self.excess[self.place, labels], minlength=count)
        grams = np.bincount(owner, weights=self.grams[self.place, 0], minlength=count)
        spread = np.bincount(owner, weights=self.model.spread[labels] * self.grams[self.place, 0], minlength=count)
        return by / np.maximum(spread, 1e-9) * (grams > 0), np.bincount(owner, weights=self.grams[self.place, 1], minlength=count)


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, spans: bool = False, fitness: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, and ``spans`` (start, end, lang: runs of
    words of one language, offsets in characters) if asked for.

    With ``fitness`` also ``n_letters``, ``known_share`` (share of letters in words of a script that a
    learned language uses) and ``fit``: by how many deviations of a single n-gram the text's n-grams
    are on average likelier than those its languages were learned from (below 0: less likely).

    lang_pred has most of the text's letters, score is its share of them; ties take the first
    language by code point. Null texts and texts without a letter, or any text when no language has
    been learned: ``und``, 0, no spans. Repeated rows stay; an empty table gives no rows.
    """
    kind = type_of(docs, "doc_id")
    fields = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("lang", pa.string())]

    def runs(text: str, labels: np.ndarray, letters: np.ndarray) -> list[dict]:
        found: list[dict] = []
        for match, label, n in zip(re.finditer(r"\S+", text), labels, letters):
            if n:
                name = model.languages[label]
                if found and found[-1]["lang"] == name:
                    found[-1]["end"] = match.end()
                else:
                    found.append({"start": match.start(), "end": match.end(), "lang": name})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty, fitness)
        count = max(len(model.languages), 1)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = [re.findall(r"\S+", t.lower()) if spans else t.lower().split() for t in texts]
                if not model.languages:
                    tokens = [[] for _ in texts]
                labels, letters, lengths = labeller.label(tokens)
                owner = np.repeat(np.arange(len(texts)), lengths)
                by = np.bincount(owner * count + labels, weights=letters, minlength=len(texts) * count).reshape(-1, count)
                total, best = by.sum(axis=1), by.argmax(axis=1)
                names = [model.languages[b] if t else "und" for b, t in zip(best, total)]
                score = by[np.arange(len(texts)), best] / np.maximum(total, 1)
                arrays = [part.column(0), pa.array(names, pa.string()), pa.array(score)]
                if spans:
                    cuts = np.cumsum(lengths)[:-1]
                    own = [runs(*x) for x in zip(texts, np.split(labels, cuts), np.split(letters, cuts))]
                    arrays.append(pa.array(own, pa.list_(pa.struct(fields))))
                if fitness:
                    fit, used = labeller.fits(labels, owner, len(texts)) if model.languages else (np.zeros(len(texts)),) * 2
                    arrays += [pa.array(total.astype(np.int64)), pa.array(used / np.maximum(total, 1)), pa.array(fit)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", *rest])

    rest = ["spans"] * spans + ["n_letters", "known_share", "fit"] * fitness
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    schema += ", n_letters bigint, known_share double, fit double" * fitness
    found = docs.select("doc_id", "text").mapInArrow(run, schema)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *rest)
