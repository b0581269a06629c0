"""Semantic adjustment and calibration over tables of spans, and training data for span models.

Embeddings are input columns; no model runs here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import calibration as cal
from maskwright.functions.nearest import nearest_of_groups
from maskwright.functions.spans import span_context

# --- Fixed values: what stands in for a type without prototypes, and the training minimum.
UNKNOWN_TYPE_SIMILARITY = 0.5
MIN_NER_EXAMPLES = 50
# --- end of fixed values

VECTORS_PER_BLOCK = 8192  # prototypes that a task holds at once
COMPARISONS_PER_SLICE = 4_000_000
ROWS_PER_SLICE = 2_000
SLICED_LABELS = 10_000  # labels at most that are sliced, those with the most work
GROUP = ["__label", "__block", "__slice"]


def _blocks(vectors: DataFrame) -> DataFrame:
    """(label, v, block, blocks): the distinct unit vectors of each label in blocks of about ``VECTORS_PER_BLOCK``."""
    known = vectors.filter("v is not null and label is not null").distinct()
    sizes = known.groupBy("label").agg(F.ceil(F.count("*") / VECTORS_PER_BLOCK).cast("int").alias("blocks"))
    return known.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))


def _nearest(rows: DataFrame, counts: DataFrame, label: Column, vector: str, blocks: DataFrame, name: str) -> DataFrame:
    """``rows`` (with an ``__id``) with ``name``: the highest similarity of ``vector`` to its label's blocks.

    ``counts`` is (label, n) of the rows. A label's rows are dealt out in slices of about ``ROWS_PER_SLICE``,
    or fewer that take ``COMPARISONS_PER_SLICE``, and its blocks repeated for each. Prototypes and
    rows travel in one shuffle, sorted so that a slice's prototypes come first: a task holds one block, and
    rows stream past it. Only if a label has several blocks, rows are repeated and the highest similarity is
    a partial maximum. So neither a type's prototypes nor its rows are ever gathered.
    """
    sizes = blocks.groupBy("label").agg(F.count("*").alias("m"), F.max("blocks").alias("blocks"))
    several = sizes.filter("blocks > 1")
    met_at_once = F.least(F.coalesce("m", F.lit(0)), F.lit(VECTORS_PER_BLOCK))
    work = F.ceil(F.col("n") * met_at_once / COMPARISONS_PER_SLICE + F.col("n") / ROWS_PER_SLICE).cast("int")
    sliced = counts.join(sizes, "label", "left").select(F.col("label").alias("__label"), work.alias("__slices"))
    hot = F.broadcast(sliced.filter("__slices > 1").orderBy(F.desc("__slices")).limit(SLICED_LABELS))
    slices = F.coalesce("__slices", F.when(F.col("__label").isNull(), F.lit(SLICED_LABELS)).otherwise(F.lit(1)))

    dealt = rows.withColumn("__label", label).join(hot, "__label", "left")
    dealt = dealt.withColumn("__slice", F.pmod(F.xxhash64("__id"), slices).cast("int")).drop("__slices")
    repeated = not several.isEmpty()
    if repeated:
        widths = F.broadcast(several.select(F.col("label").alias("__label"), F.col("blocks").alias("__blocks")))  # bounded by the blocks
        each = F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))
        dealt = dealt.join(widths, "__label", "left").withColumn("__block", each).drop("__blocks")
    else:
        dealt = dealt.withColumn("__block", F.lit(0))
    dealt = dealt.withColumn("__proto", F.lit(False)).withColumn("__v", F.col(vector).cast("array<double>"))

    shown = blocks.select(F.col("label").alias("__label"), F.col("block").alias("__block"), F.col("v").alias("__v"))
    shown = shown.join(hot, "__label", "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    shown = shown.withColumn("__proto", F.lit(True)).drop("__slices")
    # Not deterministic, as far as Spark knows: it keeps the order of rows below it.
    best = F.arrow_udf(nearest_of_groups, "double").asNondeterministic()
    met = dealt.unionByName(shown, allowMissingColumns=True).repartition(*GROUP)
    met = met.sortWithinPartitions(*GROUP, F.desc("__proto")).withColumn(name, best(*GROUP, "__proto", "__v"))
    met = met.filter("not __proto").drop(*GROUP, "__proto", "__v")
    if not repeated:
        return met
    carried = [F.any_value(f"`{c}`").alias(c) for c in rows.columns if c != "__id"]
    return met.groupBy("__id").agg(F.max(name).alias(name), *carried)


def semantic_scores(spans: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Add pattern_similarity and context_similarity to spans with two embedding columns.

    ``spans`` has entity_type, embedding and context_embedding. ``prototypes`` has kind, label and
    embedding: kind ``pattern`` (label: an entity type) or ``context``. Each span is compared with
    the patterns of its own type and with all contexts, of which there may be any number. Spans without
    a type, a vector or prototypes get the similarity of an unknown type, and 0 for contexts.
    ``prototypes`` is read several times, once at the call.
    """
    vectors = prototypes.select("kind", "label", cal.unit(F.col("embedding")).alias("v"))
    patterns = _blocks(vectors.filter("kind = 'pattern'").select("label", "v"))
    contexts = _blocks(vectors.filter("kind = 'context'").select(F.lit("context").alias("label"), "v"))
    counts = spans.groupBy(F.col("entity_type").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).select(F.lit("context").alias("label"), "n")
    rows = spans.withColumn("__id", F.monotonically_increasing_id())
    rows = _nearest(rows, counts, F.col("entity_type"), "embedding", patterns, "__pattern")
    rows = _nearest(rows, total, F.lit("context"), "context_embedding", contexts, "__context")
    return rows.select(
        *[F.col(f"`{c}`") for c in spans.columns],
        F.coalesce("__pattern", F.lit(UNKNOWN_TYPE_SIMILARITY)).alias("pattern_similarity"),
        F.greatest(F.lit(0.0), F.coalesce("__context", F.lit(0.0))).alias("context_similarity"),
    )


def enhance(spans: DataFrame, prototypes: DataFrame, text_col: str = "text") -> DataFrame:
    """Spans with the wider context and the confidence it supports.

    ``spans`` has text, entity_type, start, end, confidence and the two embedding columns.
    """
    context = span_context(F.col(text_col), F.col("start"), F.col("end"), cal.SEMANTIC_WINDOW)
    scored = semantic_scores(spans, prototypes).withColumn("context", context)
    relevance = cal.context_relevance(F.col("context"))
    return scored.withColumn("context_relevance", relevance).withColumn(
        "confidence",
        cal.adjust_confidence(
            F.col("confidence"), F.col("pattern_similarity"), F.col("context_similarity"), F.col("context_relevance")
        ),
    )


def enhance_texts(detected: DataFrame, vectors: DataFrame, prototypes: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Detected texts with the entities' context and confidence as ``enhance`` gives them.

    ``detected`` has the ``key``, which is unique, the text and its entities; ``vectors`` is (key, ord,
    embedding, context_embedding) of the entity at place ``ord`` of the array. The entities keep their
    order; those without vectors are enhanced by their context alone. Grouping is per text.
    """
    spans = detected.select(key, text_col, F.posexplode("entities").alias("ord", "entity"))
    spans = spans.select(
        key, text_col, "ord", "entity", F.col("entity.entity_type").alias("entity_type"), F.col("entity.start").alias("start"),
        F.col("entity.end").alias("end"), F.col("entity.confidence").alias("confidence"),
    )
    found = enhance(spans.join(vectors.select(key, "ord", "embedding", "context_embedding"), [key, "ord"], "left"), prototypes, text_col)
    entity = F.col("entity").withField("confidence", F.col("confidence")).withField("context", F.col("context"))
    in_order = F.array_sort(F.collect_list(F.struct("ord", entity.alias("entity"))))
    grouped = found.groupBy(key).agg(F.transform(in_order, lambda x: x["entity"]).alias("__enhanced"))
    whole = F.coalesce("__enhanced", "entities").alias("entities")
    return detected.join(grouped, key, "left").select(*[whole if c == "entities" else F.col(f"`{c}`") for c in detected.columns])


def span_features(detected: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per detected span with its five calibration scores."""
    others = [c for c in detected.columns if c not in ("entities", "detection_metadata")]
    return detected.select(*others, F.posexplode("entities").alias("ord", "entity")).withColumn(
        "features", cal.calibration_features(F.col("entity"), F.length(text_col))
    )


def calibrate(features: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    return features.withColumn("calibrated_confidence", cal.calibrated(F.col("features"), weights))


def train_calibrator(samples: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """One row of weights fitted to (features, label) samples.

    Weights grow with how far the score differs between right and wrong spans. With fewer than ten
    samples nothing is trained; with one class only, the weights stay as they are.
    """
    weights = weights or cal.FEATURE_WEIGHTS
    label = F.col("label")

    def mean(name: str, value: float) -> Column:
        return F.avg(F.when(label == value, F.col("features")[name]))

    stats = samples.agg(
        F.count("*").alias("samples"),
        *[F.abs(mean(n, 1.0) - mean(n, 0.0)).alias(f"d_{n}") for n in weights],
    )
    trained = F.col("samples") >= cal.MIN_CALIBRATION_SAMPLES
    first = next(iter(weights))
    both = trained & F.col(f"d_{first}").isNotNull()
    raw = {n: F.lit(float(w)) * (F.lit(1.0) + F.col(f"d_{n}") * F.lit(0.1)) for n, w in weights.items()}
    total = F.lit(0.0)
    for value in raw.values():
        total = total + value
    return stats.select(
        *[F.when(both, raw[n] / total).otherwise(F.lit(float(w))).alias(n) for n, w in weights.items()],
        "samples",
        trained.alias("is_trained"),
    )


def fitted_weights(samples: DataFrame) -> dict[str, float]:
    """The five trained weights, for use in ``calibrate``."""
    row = train_calibrator(samples).first()
    return {name: row[name] for name in cal.FEATURE_WEIGHTS}


def ner_examples(texts: DataFrame, spans: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, text, entities) examples; spans keep the order of the ``order`` columns.

    ``spans`` is (key, start, end, label, *order). Grouping is per text.
    """
    fields = [F.col(c) for c in order] + [F.col("start"), F.col("end"), F.col("label")]
    grouped = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__s"))
    entities = F.transform(
        F.coalesce("__s", F.array()),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")),
    )
    return texts.join(grouped, key, "left").withColumn("entities", entities).drop("__s")


def ner_readiness(examples: DataFrame) -> DataFrame:
    """Number of examples, whether they are enough, and their labels: one row per label."""
    labels = examples.select(F.explode("entities").alias("e")).groupBy(F.col("e.label").alias("label")).agg(
        F.count("*").alias("value")
    )
    count = examples.agg(F.count("*").alias("value"))
    return count.select(
        F.when(F.col("value") >= MIN_NER_EXAMPLES, F.lit("examples_sufficient"))
        .otherwise(F.lit("examples_insufficient"))
        .alias("item"),
        "value",
    ).unionByName(labels.select(F.concat(F.lit("label:"), "label").alias("item"), "value"))
