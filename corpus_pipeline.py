"""From raw documents to a training mix: language, repeated lines, near-duplicates, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its result is written and
read again before the next. Rows are told apart by doc_id and a key of their text, null ids included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, langid, line_dedup, mixing, simhash
from maskwright.llm.tables import saved, table, text_key

#: Documents of which no language holds this share of the letters are rejected.
MIN_SHARE = 1 / 3
#: So are those of whose letters fewer than this share stand in words of a learned language's script,
MIN_KNOWN = 1 / 2
#: and those whose n-grams are on average this many deviations less likely than those of the texts
#: their language was learned from; a text of n letters has 1 / sqrt(n) more to go.
MAX_UNLIKELY = 1.75
MIX = ("mix_size", "mix_taken", "mix_target")


def _packed(docs: DataFrame) -> DataFrame:
    """(id, key, row): all columns in one, so that none can clash with those of a stage."""
    return docs.select(F.col("doc_id").alias("id"), text_key().alias("key"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text) with the id and the key of the text as one doc_id."""
    return docs.select(F.struct("doc_id", text_key().alias("key")).alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _matched(docs: DataFrame, found: DataFrame, how: str, *more: str) -> DataFrame:
    """Packed rows joined to ``found`` (one row a combined doc_id) by that id."""
    other = found.select(F.col("doc_id.doc_id").alias("other_id"), F.col("doc_id.key").alias("other_key"), *more)
    rows = _packed(docs)
    return rows.join(other, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("key") == F.col("other_key")), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter, those that are no language's for a third, those mostly in scripts
    that no learned language uses, and those that are much less likely than their language's own texts.

    Null, empty and letterless texts go. Languages are learned from the documents themselves; if
    none has a lang, only the letterless go. Whole texts are judged, however long; equal rows fare
    alike; a share or likelihood on its bound stays. All columns come back as they are, whatever
    their names. An empty table stays empty.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(_keyed(docs), model, fitness=True)
    unlikely = F.col("fit") < -(F.lit(MAX_UNLIKELY) + 1 / F.sqrt("n_letters"))
    other = (F.col("score") < MIN_SHARE) | (F.col("known_share") < MIN_KNOWN) | unlikely
    rejected = found.filter((F.col("lang_pred") == "und") | other).select("doc_id").distinct()
    return _matched(docs, rejected, "left_anti").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated three-line windows; documents of which nothing but blanks is left go.

    n_chars of changed texts is set anew. Texts that were null or blank before stay. Of equal windows
    the first by doc_id stays, and rows with equal id and text are one document. A text may have any
    number of lines. The other columns come back as they are, whatever their names. An empty table
    stays empty.
    """
    found = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")))
    changed = F.col("__removed") > 0
    found = found.filter(~(changed & (F.trim(F.replace("text", F.lit("\n"))) == "")))

    def column(name: str) -> Column:
        own = F.col("row")[name]
        if name == "n_chars":
            own = F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return (F.col("text") if name == "text" else own).alias(name)

    return found.select(*[column(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of texts whose SimHash fingerprints (shingles of four words)
    are joined by links of four bits or fewer: the smallest doc_id, null first, then text key.

    Of equal rows one stays. Null and blank texts have fingerprint 0 and are linked like others. Whole
    texts count, however long. All columns come back as they are, whatever their names; of rows with
    equal id and text that differ elsewhere any one stays. An empty table stays empty.
    """
    found = saved(simhash.near_duplicates(_keyed(docs), shingle_words=4, radius=4), "classes")
    gone = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    known = saved(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.first(gone).alias("gone")), "copies")
    single = _matched(docs, known.filter("gone or n > 1"), "left_anti").select("row.*")
    many = _matched(docs, known.filter("not gone and n > 1"), "left_semi")
    return single.unionByName(many.dropDuplicates(["id", "key"]).select("row.*"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, anywhere in the text. Null and empty texts hold none and
    stay; equal rows fare alike. All columns come back as they are, whatever their names. An empty
    table stays empty, and one is returned whole if the benchmark is empty."""
    found = decontaminate.leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = found.select(F.struct("doc_id", F.col("text_key").alias("key")).alias("doc_id")).distinct()
    return _matched(docs, gone, "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``mix_size`` (words), ``mix_taken`` (words with
    repeats) and ``mix_target`` (its source's).

    Equal rows become one, which takes for all. Null and empty texts have no words and are not taken; a
    null source is a source; whole texts count, however long. Documents with equal id stand together
    in the seeded order. Own columns of those three names are replaced, all others come back as they
    are. An empty table stays empty.
    """
    source = F.col("source").cast("string").alias("source")
    found = mixing.mix(_keyed(docs, source), F.array("source")).groupBy("doc_id").agg(
        F.sum("size").alias("mix_size"), F.sum("taken").alias("mix_taken"), F.first("target").alias("mix_target")
    )
    found = saved(found.filter("mix_taken > 0"), "mixed")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in MIX]
    return _matched(docs, found, "inner", *MIX).dropDuplicates(["id", "key"]).select(*own, *MIX)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

#: Language ID has no SQL form; tests hold each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
