"""Registered queries over text: detection, masking, policy and outbound checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import masking, policy as policies, registry, scoring, spans
from maskwright.functions.policy import Policy
from maskwright.operators import detect as detection, policies as policy_tables, sanitize as sanitizing
from maskwright.plans import oracle as o
from maskwright.plans.catalog import query
from maskwright.plans.corpus import corpus, table
from maskwright.sources.folders import new_folder


def entity_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per detected span."""
    return df.select(key, F.posexplode("entities").alias("ord", "e"), "risk_score", "has_high_risk_pii").select(
        key,
        F.col("e.entity_type").alias("entity_type"),
        F.col("e.start").alias("start_pos"),
        F.col("e.end").alias("end_pos"),
        F.col("e.confidence").alias("confidence"),
        F.col("e.text").alias("matched_text"),
        F.col("e.context").alias("context"),
        "risk_score",
        "has_high_risk_pii",
    )


def _entity_sql(src: str, key: str) -> str:
    return (
        f"with {o.detection_ctes(src)} select ent.id as {key}, typ as entity_type, s as start_pos, e as end_pos, "
        "c as confidence, txt as matched_text, context, risk as risk_score, high as has_high_risk_pii "
        "from ent join doc on doc.id = ent.id"
    )


@query(
    "sanitize_documents",
    f"with {o.sanitize_ctes(o.DOCUMENTS_SRC)} select id as doc_id, action as action_taken, sanitized as sanitized_text, "
    "risk as risk_score, high as has_high_risk_pii, n as total_entities, blocked_reason from out",
)
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sanitizing.sanitize(df).select(
        "doc_id", "action_taken", "sanitized_text", "risk_score", "has_high_risk_pii",
        F.size("entities").alias("total_entities"), "blocked_reason",
    )


@query("detect_documents", _entity_sql(o.DOCUMENTS_SRC, "doc_id"))
def detect_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return entity_rows(detection.detect(df), "doc_id")


@query("detect_pages", _entity_sql(o.PAGES_SRC, "page_id"))
def detect_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return entity_rows(detection.detect(df), "page_id")


@query("detect_urls", _entity_sql(o.URLS_SRC, "page_id"))
def detect_urls(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    return entity_rows(detection.detect(df), "page_id")


@query("detect_corpus", _entity_sql(o.CORPUS_SRC, "doc_id"))
def detect_corpus(spark, sf_dir):
    return entity_rows(detection.detect(corpus(spark, sf_dir)), "doc_id")


_METADATA_SQL = """select doc.id as doc_id, coalesce(pattern_n, 0)::int as pattern_entities,
  coalesce(business_n, 0)::int as business_entities, n as total_entities, risk as risk_score
  from doc left join (select id, count(*) filter (source = 'pattern') as pattern_n,
  count(*) filter (source = 'business') as business_n from raw group by id) r on r.id = doc.id"""


@query("detection_metadata", f"with {o.detection_ctes(o.CORPUS_SRC)} {_METADATA_SQL}")
def detection_metadata(spark, sf_dir):
    return detection.detect(corpus(spark, sf_dir)).select(
        "doc_id",
        F.col("detection_metadata.pattern_entities").alias("pattern_entities"),
        F.col("detection_metadata.business_entities").alias("business_entities"),
        F.col("detection_metadata.total_entities").alias("total_entities"),
        F.col("detection_metadata.risk_score").alias("risk_score"),
    )


@query("detect_business_only", f"with {o.detection_ctes(o.CORPUS_SRC, custom=False)} {_METADATA_SQL}")
def detect_business_only(spark, sf_dir):
    return detection.detect(corpus(spark, sf_dir), custom=False).select(
        "doc_id",
        F.col("detection_metadata.pattern_entities").alias("pattern_entities"),
        F.col("detection_metadata.business_entities").alias("business_entities"),
        F.col("detection_metadata.total_entities").alias("total_entities"),
        F.col("detection_metadata.risk_score").alias("risk_score"),
    )


def _recognize(entity_type: str):
    def run(spark, sf_dir):
        found = corpus(spark, sf_dir).select(
            "doc_id", F.explode(spans.recognize(F.col("text"), [entity_type])).alias("s")
        )
        return found.select(
            "doc_id",
            F.col("s.start").alias("start_pos"),
            F.col("s.end").alias("end_pos"),
            F.col("s.text").alias("matched_text"),
            F.col("s.confidence").alias("confidence"),
        )

    return run


for _type in [*registry.CUSTOM_PATTERNS, *registry.BUSINESS_PATTERNS]:
    query(
        f"recognize_{_type.lower()}",
        f"with {o.raw_ctes(o.CORPUS_SRC, [_type])} select id as doc_id, s as start_pos, e as end_pos, "
        "txt as matched_text, conf as confidence from raw",
    )(_recognize(_type))


@query(
    "context_flags",
    "select doc_id, "
    + ", ".join(
        f"{o.keyword_test('text', words)} as has_{t.lower()}" for t, words in registry.CONTEXT_KEYWORDS.items()
    )
    + ", false as has_url from documents",
)
def context_flags(spark, sf_dir):
    flags = [
        spans.has_context(F.col("text"), t).alias(f"has_{t.lower()}")
        for t in [*registry.CONTEXT_KEYWORDS, "URL"]
    ]
    return table(spark, sf_dir, "documents").select("doc_id", "text").select("doc_id", *flags)


@query(
    "confidence_levels",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select id as doc_id, s as start_pos, typ as entity_type, "
    "case when c >= 0.9 then 'high' when c >= 0.7 then 'medium' else 'low' end as confidence_level from ent",
)
def confidence_levels(spark, sf_dir):
    rows = entity_rows(detection.detect(corpus(spark, sf_dir)), "doc_id")
    return rows.select(
        "doc_id", "start_pos", "entity_type", scoring.confidence_level(F.col("confidence")).alias("confidence_level")
    )


@query(
    "filter_confidence",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select doc.id as doc_id, coalesce(kept, 0)::int as kept_entities, "
    "risk as risk_score, high as has_high_risk_pii from doc left join "
    "(select id, count(*) as kept from ent where c >= 0.8 group by id) k on k.id = doc.id",
)
def filter_confidence(spark, sf_dir):
    return detection.detect(corpus(spark, sf_dir)).select(
        "doc_id",
        F.size(scoring.filter_confidence(F.col("entities"), 0.8)).alias("kept_entities"),
        "risk_score",
        "has_high_risk_pii",
    )


@query(
    "risk_indicator",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select id as doc_id, s as start_pos, typ as entity_type, "
    f"typ in {o.strings(registry.RISK_INDICATOR_TYPES)} as is_red from ent",
)
def risk_indicator(spark, sf_dir):
    rows = entity_rows(detection.detect(corpus(spark, sf_dir)), "doc_id")
    return rows.select(
        "doc_id", "start_pos", "entity_type", scoring.risk_indicator(F.col("entity_type")).alias("is_red")
    )


@query(
    "high_risk_filter",
    f"with {o.detection_ctes(o.DOCUMENTS_SRC)} select source, count(*) as texts, "
    "count(*) filter (high) as high_risk_texts from doc join documents d on d.doc_id = doc.id group by source",
)
def high_risk_filter(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return (
        detection.detect(df)
        .groupBy("source")
        .agg(F.count("*").alias("texts"), F.count_if("has_high_risk_pii").alias("high_risk_texts"))
    )


_TONE = "case doc_id % 4 when 0 then 'clear' when 1 then 'professional' when 2 then 'friendly' else 'shouty' end"


@query(
    "outbound_valid",
    f"select doc_id, {_TONE} as tone, case when doc_id % 4 = 3 then 'unsupported_tone' "
    "when trim(text) = '' or length(text) > 10000 then 'invalid_length' else 'ok' end as status from documents",
)
def outbound_valid(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    tone = F.expr(_TONE)
    return df.select("doc_id", tone.alias("tone"), sanitizing.outbound_status(F.col("text"), tone).alias("status"))


_BLANKS = "select -1 - doc_id as doc_id, case doc_id % 3 when 0 then '  ' when 1 then '' end as text from"


@query(
    "reject_blank",
    f"select doc_id, text from (select doc_id, text from ({o.CORPUS}) union all {_BLANKS} ({o.CORPUS})) where trim(text) <> ''",
)
def reject_blank(spark, sf_dir):
    texts = corpus(spark, sf_dir).select("doc_id", "text")
    return sanitizing.reject_blank(texts.unionByName(spark.sql(f"{_BLANKS} {{texts}}", texts=texts)))


@query(
    "resolve_overlaps",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select doc.id as doc_id, coalesce(raw_n, 0)::int as raw_spans, n as resolved_spans, "
    "coalesce(layout, '') as layout from doc left join (select id, count(*) as raw_n from raw group by id) r on r.id = doc.id "
    "left join (select id, string_agg(typ || '@' || s || '-' || e, ' ' order by ord) as layout from ent group by id) l on l.id = doc.id",
)
def resolve_overlaps(spark, sf_dir):
    raw = corpus(spark, sf_dir).select("doc_id", F.inline(F.array(F.struct(spans.recognize(F.col("text")).alias("raw")))))
    resolved = raw.select("doc_id", F.size("raw").alias("raw_spans"), spans.resolve_overlaps(F.col("raw")).alias("kept"))
    return resolved.select(
        "doc_id",
        "raw_spans",
        F.size("kept").alias("resolved_spans"),
        F.array_join(
            F.transform(
                "kept",
                lambda s: F.concat(
                    s["entity_type"], F.lit("@"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")
                ),
            ),
            " ",
        ).alias("layout"),
    )


_EXTERNAL_ROWS = """
select c_custkey as doc_id, 'PERSON' as entity_type, 0 as start, 4 as `end`, cast(0.85 as double) as confidence from {customer} where c_custkey % 3 = 0
union all
select c_custkey, 'EMAIL_ADDRESS', 0, 12, cast(0.95 as double) from {customer} where c_custkey % 5 = 1
union all
select c_custkey, 'LOCATION', 5, 9, cast(null as double) from {customer} where c_custkey % 7 = 2
"""
_EXTERNAL_CTE = (
    "select src.id, x.start, x.\"end\", -1000000 + row_number() over (partition by src.id order by x.start, x.\"end\", "
    "case x.entity_type when 'EMAIL_ADDRESS' then 'EMAIL' else x.entity_type end)::int, "
    "case x.entity_type when 'EMAIL_ADDRESS' then 'EMAIL' else x.entity_type end, coalesce(x.confidence, 0.8::double), 'external', "
    "substring(src.text, x.start + 1, x.\"end\" - x.start) from ("
    + _EXTERNAL_ROWS.format(customer="customer").replace("`end`", '"end"')
    + ") x join src on src.id = x.doc_id"
)


def external_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EXTERNAL_ROWS, customer=table(spark, sf_dir, "customer"))


@query(
    "resolve_external",
    f"with {o.detection_ctes(o.CORPUS_SRC, external=_EXTERNAL_CTE)} select ent.id as doc_id, typ as entity_type, s as start_pos, "
    "e as end_pos, c as confidence, txt as matched_text, context, risk as risk_score, high as has_high_risk_pii from ent join doc on doc.id = ent.id",
)
def resolve_external(spark, sf_dir):
    from maskwright.operators.external import external_spans

    joined = external_spans(corpus(spark, sf_dir), external_rows(spark, sf_dir), "doc_id")
    return entity_rows(detection.detect(joined, external_col="external_spans"), "doc_id")


# Two spans of a model at each text's start, of equal place and confidence, in the model's order.
_TIED = "case when doc_id % 2 = 0 then 'PERSON' else 'LOCATION' end"
_TIED_LATER = "case when doc_id % 2 = 0 then 'LOCATION' else 'PERSON' end"
_TIED_CTE = (
    f"select id, 0, 4, -1000000 + rank, typ, 0.95::double, 'external', substring(text, 1, 4) from (select id, text, 1 as rank, {_TIED.replace('doc_id', 'id')} as typ from src "
    f"union all select id, text, 2, {_TIED_LATER.replace('doc_id', 'id')} from src)"
)


@query(
    "external_in_order",
    f"with {o.detection_ctes(o.CORPUS_SRC, external=_TIED_CTE)} select ent.id as doc_id, typ as entity_type, s as start_pos, "
    "e as end_pos, c as confidence, txt as matched_text, context, risk as risk_score, high as has_high_risk_pii from ent join doc on doc.id = ent.id",
)
def external_in_order(spark, sf_dir):
    """Spans that tie keep the order in which their model gave them."""
    from maskwright.operators.external import external_spans

    texts = corpus(spark, sf_dir)
    given = texts.selectExpr("doc_id", f"explode(array(struct(2 as rank, {_TIED_LATER} as t), struct(1 as rank, {_TIED} as t))) as x")
    rows = given.selectExpr("doc_id", "x.t as entity_type", "0 as start", "4 as `end`", "0.95D as confidence", "x.rank as rank")
    joined = external_spans(texts, rows, "doc_id", order=["rank"])
    return entity_rows(detection.detect(joined, external_col="external_spans"), "doc_id")


# --- masking


def _mask_sql(kind: str, source: str) -> str:
    return (
        f"with {o.detection_ctes(source)}, {o.spliced_cte('spl', o.mask_sql(kind))} "
        "select id as doc_id, masked as masked_text from spl"
    )


def _mask_query(kind: str, texts):
    def run(spark, sf_dir):
        return sanitizing.mask_uniform(texts(spark, sf_dir), kind).select("doc_id", "masked_text")

    return run


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


for _kind in ("full", "partial", "hash", "redact", "synthetic"):
    query(f"mask_{_kind}", _mask_sql(_kind, o.CORPUS_SRC))(_mask_query(_kind, corpus))
    query(f"mask_{_kind}_documents", _mask_sql(_kind, o.DOCUMENTS_SRC))(_mask_query(_kind, _documents))


@query(
    "mask_synthetic_persons",
    f"with {o.detection_ctes(o.CORPUS_SRC, external=_EXTERNAL_CTE)}, {o.spliced_cte('spl', o.mask_sql('synthetic'))} "
    "select id as doc_id, masked as masked_text from spl",
)
def mask_synthetic_persons(spark, sf_dir):
    """Synthetic masking with spans from outside, which are the only source of names."""
    from maskwright.operators.external import external_spans

    joined = external_spans(corpus(spark, sf_dir), external_rows(spark, sf_dir), "doc_id")
    return sanitizing.mask_uniform(joined, "synthetic", external_col="external_spans").select("doc_id", "masked_text")


@query("mask_synthetic_constants", _mask_sql("synthetic", o.PAGES_SRC))
def mask_synthetic_constants(spark, sf_dir):
    """Synthetic masking of pages, most of whose types have a fixed stand-in."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return sanitizing.mask_uniform(pages, "synthetic").select("doc_id", "masked_text")


_DEFAULT_CHOICE = (
    "case when typ in ('EMAIL', 'PHONE_NUMBER') then " + o.mask_sql("partial") + " else " + o.mask_sql("full") + " end"
)


@query(
    "mask_default_config",
    f"with {o.detection_ctes(o.CORPUS_SRC)}, {o.spliced_cte('spl', _DEFAULT_CHOICE)} select id as doc_id, masked as masked_text from spl",
)
def mask_default_config(spark, sf_dir):
    return sanitizing.mask(corpus(spark, sf_dir)).select("doc_id", "masked_text")


_CUSTOM_CONFIG = {
    "EMAIL": {"mask_type": "partial", "mask_char": "#"},
    "US_SSN": {"mask_type": "hash", "hash_algorithm": "md5", "salt": "s1", "hash_length": 12},
    "CREDIT_CARD": {"mask_type": "full", "mask_length": 4},
    "API_KEY": {"mask_type": "redact"},
    "DEFAULT": {"mask_type": "partial", "mask_char": "x"},
}
_CUSTOM_CHOICE = (
    f"case typ when 'EMAIL' then {o.mask_sql('partial', char=o.quoted('#'))} "
    "when 'US_SSN' then '[HASH_' || upper(left(md5(txt || 's1'), 12)) || ']' "
    "when 'CREDIT_CARD' then '****' when 'API_KEY' then '[REDACTED_' || typ || ']' "
    f"else {o.mask_sql('partial', char=o.quoted('x'))} end"
)
_CUSTOM_KIND = "case typ when 'EMAIL' then 'partial' when 'US_SSN' then 'hash' when 'CREDIT_CARD' then 'full' when 'API_KEY' then 'redact' else 'partial' end"


@query(
    "mask_custom_config",
    f"with {o.detection_ctes(o.CORPUS_SRC)}, {o.spliced_cte('spl', _CUSTOM_CHOICE)} select spl.id as doc_id, masked as masked_text, "
    "coalesce(n, 0)::int as entities_processed, methods from spl left join (select id, count(*) as n, "
    f"string_agg(distinct typ || '=' || ({_CUSTOM_KIND}), ',' order by typ || '=' || ({_CUSTOM_KIND})) as methods from ent group by id) m on m.id = spl.id",
)
def mask_custom_config(spark, sf_dir):
    masked = sanitizing.mask(corpus(spark, sf_dir), _CUSTOM_CONFIG)
    methods = F.array_sort(
        F.transform(F.map_entries("masking_methods"), lambda m: F.concat(m["key"], F.lit("="), m["value"]))
    )
    return masked.select(
        "doc_id",
        "masked_text",
        F.size("entities_masked").alias("entities_processed"),
        F.when(F.col("masking_methods").isNotNull(), F.array_join(methods, ",")).alias("methods"),
    )


def provided_spans(text: Column) -> Column:
    """Two overlapping spans and one behind them, cut from the text."""
    size = F.length(text)

    def span(kind: str, start, end, confidence: float):
        return F.struct(
            F.lit(kind).alias("entity_type"),
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            F.lit(confidence).alias("confidence"),
            spans.slice_text(text, start, end).alias("text"),
            F.lit("").alias("context"),
        )

    return F.array(
        span("EMAIL", F.lit(0), F.lit(6), 0.9),
        span("US_SSN", F.lit(3), F.lit(8), 0.9),
        span("PERSON", size - 3, size, 0.8),
    )


@query(
    "mask_provided",
    f"""with src as ({o.CORPUS_SRC}),
a as (select id, text, length(text) as n, substring(text, 1, 6) as t1, substring(text, 4, 5) as t2 from src),
b as (select *, substring(text, 1, n - 3) || '***' as m1 from a),
c as (select *, substring(m1, 1, 3) || '*****' || substring(m1, 9) as m2 from b),
d as (select *, case when contains(t1, '@') then left(t1, 1) || repeat('*', greatest(instr(t1, '@') - 2, 0)::int) || substring(t1, instr(t1, '@'))
  else left(t1, 1) || '****' || right(t1, 1) end || substring(m2, 7) as m3 from c)
select id as doc_id, case when id % 4 = 0 then null else m3 end as masked_text,
  case when id % 4 = 0 then 'no_entities' else 'ok' end as status from d""",
)
def mask_provided(spark, sf_dir):
    given = F.when(F.col("doc_id") % 4 != 0, provided_spans(F.col("text")))
    df = corpus(spark, sf_dir).withColumn("provided_entities", given)
    return sanitizing.mask_provided(df).select("doc_id", "masked_text", "status")


# --- policy

_CALLERS = "select role, bypass from (values ('user'), ('admin'), ('developer'), ('analyst')) r(role), (values (true), (false)) b(bypass)"


def _callers(df: DataFrame) -> DataFrame:
    """Every text once per role and bypass flag, without a join."""
    return df.withColumn("user_role", F.explode(F.array(*[F.lit(r) for r in ("user", "admin", "developer", "analyst")]))).withColumn(
        "bypass", F.explode(F.array(F.lit(True), F.lit(False)))
    )


def _with_external(spark, sf_dir):
    from maskwright.operators.external import external_spans

    return external_spans(corpus(spark, sf_dir), external_rows(spark, sf_dir), "doc_id")


_DECISIONS = o.decision_ctes(o.CORPUS_SRC, _CALLERS, _EXTERNAL_CTE)


@query(
    "policy_decisions",
    f"with {_DECISIONS} select id as doc_id, role as user_role, bypass, action, thr as confidence_threshold, bypass_allowed, reasons from dec",
)
def policy_decisions(spark, sf_dir):
    found = detection.detect(_with_external(spark, sf_dir), external_col="external_spans")
    decided = sanitizing.evaluate_policy(_callers(found), role=F.col("user_role"), bypass=F.col("bypass"))
    return decided.select(
        "doc_id", "user_role", "bypass",
        F.col("decision.action").alias("action"),
        F.col("decision.confidence_threshold").alias("confidence_threshold"),
        F.col("decision.bypass_allowed").alias("bypass_allowed"),
        F.array_join("decision.reasons", " | ").alias("reasons"),
    )


@query(
    "policy_by_role",
    f"with {_DECISIONS} select role as user_role, bypass, action, count(*) as decisions from dec group by all",
)
def policy_by_role(spark, sf_dir):
    return policy_decisions(spark, sf_dir).groupBy("user_role", "bypass", "action").agg(F.count("*").alias("decisions"))


@query(
    "policy_lookup",
    f"with {o.detection_ctes(o.CORPUS_SRC, external=_EXTERNAL_CTE)}, {o.policy_values()}, {o.JUDGED}, roles as (select distinct role from ({_CALLERS})) "
    f"select id as doc_id, s as start_pos, typ as entity_type, role as user_role, action, thr as confidence_threshold, "
    f"role in ('admin', 'analyst') as can_override, {o.CAN_BYPASS} as can_bypass from judged, roles",
)
def policy_lookup(spark, sf_dir):
    rows = entity_rows(detection.detect(_with_external(spark, sf_dir), external_col="external_spans"), "doc_id")
    role = F.col("user_role")
    rows = rows.withColumn(
        "user_role", F.explode(F.array(*[F.lit(r) for r in ("user", "admin", "developer", "analyst")]))
    )
    chosen = policies.policy_for_entity(Policy(), F.col("entity_type"))
    return rows.select(
        "doc_id", "start_pos", "entity_type", "user_role",
        chosen["action"].alias("action"),
        chosen["threshold"].alias("confidence_threshold"),
        policies.can_override(Policy(), role).alias("can_override"),
        policies.can_bypass(Policy(), role, F.col("entity_type")).alias("can_bypass"),
    )


# What masked types of a decision are masked with.
_MASKS_SQL = (
    "select id as doc_id, role as user_role, bypass, typ as entity_type, mtype as mask_type, any_value(thr) as confidence_threshold "
    "from considered where action = 'mask' and id in (select id from doc where n <= 5) group by all"
)


@query("decision_masking", f"with {_DECISIONS} {_MASKS_SQL}")
def decision_masking(spark, sf_dir):
    """The masking settings that decisions carry, their thresholds included."""
    found = detection.detect(_with_external(spark, sf_dir), external_col="external_spans")
    decided = sanitizing.evaluate_policy(_callers(found), role=F.col("user_role"), bypass=F.col("bypass"))
    return decided.select("doc_id", "user_role", "bypass", F.explode("decision.masking_config").alias("entity_type", "m")).select(
        "doc_id", "user_role", "bypass", "entity_type", F.col("m.mask_type").alias("mask_type"), F.col("m.confidence_threshold").alias("confidence_threshold")
    )


# Sections that replace those of the built-in document.
_STRICT = """
default_policy: {action: warn, confidence_threshold: 0.6}
entity_policies:
  EMAIL: {action: block, confidence_threshold: 0.7}
  PHONE_NUMBER: {action: mask, confidence_threshold: 0.6, mask_type: hash}
  URL: {action: allow, confidence_threshold: 0.5}
  IP_ADDRESS: {action: mask, confidence_threshold: 0.65, mask_type: redact}
"""
_STRICT_POLICY = Policy().merged(policies.parse_policy(_STRICT).document)
_ROLE = "select 'analyst' as role, false as bypass"


def _decided_sql(src: str, policy: Policy) -> str:
    masks = "select id, string_agg(distinct typ || '=' || mtype || '@' || thr, ' ' order by typ || '=' || mtype || '@' || thr) as m from considered where action = 'mask' group by id"
    return (
        f"select * from (with {o.decision_ctes(src, _ROLE, policy=policy)}, masks as ({masks}) "
        "select dec.id as doc_id, dec.action, thr as confidence_threshold, bypass_allowed, reasons, case when n <= 5 then coalesce(m, '') else '' end as masks "
        "from dec join doc on doc.id = dec.id left join masks on masks.id = dec.id)"
    )


@query(
    "policies_by_row",
    f"{_decided_sql(o.CORPUS_SRC + ' where doc_id % 3 <> 0', Policy())} union all {_decided_sql(o.CORPUS_SRC + ' where doc_id % 3 = 0', _STRICT_POLICY)}",
)
def policies_by_row(spark, sf_dir):
    """Two policies in one table: a YAML file is loaded, its sections replace those of a copy of the
    built-in document, and each row is judged by the policy that it names."""
    path = new_folder(spark, "policy")
    spark.createDataFrame([(_STRICT,)], "value string").coalesce(1).write.text(path, lineSep="\n")
    loaded = policies.load_policy(path, spark)
    documents = policy_tables.merge_documents(
        policy_tables.policy_documents(spark, {"default": Policy(), "strict": Policy()}),
        policy_tables.policy_documents(spark, {"strict": loaded}),
    )
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("strict")).when(F.col("doc_id") % 3 == 1, F.lit("default")).otherwise(F.lit("unknown"))
    found = policy_tables.with_policy(detection.detect(corpus(spark, sf_dir)), name, policy_tables.compile_policies(documents))
    decided = sanitizing.evaluate_policy(found, F.col("rules"), role="analyst")
    masks = F.transform(
        F.map_entries("decision.masking_config"), lambda m: F.concat(m["key"], F.lit("="), m["value"]["mask_type"], F.lit("@"), m["value"]["confidence_threshold"].cast("string"))
    )
    return decided.select(
        "doc_id",
        F.col("decision.action").alias("action"),
        F.col("decision.confidence_threshold").alias("confidence_threshold"),
        F.col("decision.bypass_allowed").alias("bypass_allowed"),
        F.array_join("decision.reasons", " | ").alias("reasons"),
        F.array_join(F.array_sort(masks), " ").alias("masks"),
    )


@query(
    "document_validation",
    """with p as (select 'p' || c_custkey as policy, c_custkey % 4 as a, c_custkey % 5 as t, c_custkey % 3 as m from customer)
select policy, 'entity_policies' as section, 'EMAIL' as name, 'Invalid confidence_threshold for ''EMAIL'': ' || case t when 1 then '1.5' when 2 then '0.5' else 'often' end as error from p where t in (1, 2, 3)
union all select policy, 'entity_policies', 'EMAIL', 'Invalid mask_type for ''EMAIL'': blur' from p where a = 0 and m = 0
union all select policy, 'entity_policies', 'EMAIL', 'Invalid action for ''EMAIL'': deny' from p where a = 1
union all select policy, 'entity_policies', 'EMAIL', 'Entity policy ''EMAIL'' missing ''action'' field' from p where a = 2
union all select policy, 'default_policy', 'default', 'Invalid action in default_policy: deny' from p where a = 1""",
)
def document_validation(spark, sf_dir):
    """Errors of whole documents, of which a threshold in quotes is one."""
    k = F.col("c_custkey")
    action = F.when(k % 4 == 0, F.lit("mask")).when(k % 4 == 1, F.lit("deny")).when(k % 4 == 3, F.lit("warn"))
    fields = F.array_compact(F.array(
        F.when(action.isNotNull(), F.concat(F.lit('"action": "'), action, F.lit('"'))),
        F.when(k % 3 == 0, F.lit('"mask_type": "blur"')).otherwise(F.lit('"mask_type": "hash"')),
        F.when(k % 5 == 0, F.lit('"confidence_threshold": 0.5')).when(k % 5 == 1, F.lit('"confidence_threshold": 1.5'))
        .when(k % 5 == 2, F.lit('"confidence_threshold": "0.5"')).when(k % 5 == 3, F.lit('"confidence_threshold": "often"')),
    ))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), k.cast("string")).alias("policy"),
        F.explode(F.create_map(
            F.lit("default_policy"), F.concat(F.lit('{"action": "'), F.coalesce(action, F.lit("allow")), F.lit('"}')),
            F.lit("entity_policies"), F.concat(F.lit('{"EMAIL": {'), F.array_join(fields, ", "), F.lit("}}")),
        )).alias("section", "body"),
    )
    return policy_tables.validate_documents(rows.withColumn("body", F.parse_json("body")))


@query(
    "high_risk_types",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select doc.id as doc_id, coalesce(t, '') as high_risk_types from doc left join "
    f"(select id, string_agg(distinct typ, ',' order by typ) as t from ent where typ in {o.HIGH} group by id) x on x.id = doc.id",
)
def high_risk_types(spark, sf_dir):
    return detection.detect(corpus(spark, sf_dir)).select(
        "doc_id", F.array_join(scoring.high_risk_types(F.col("entities")), ",").alias("high_risk_types")
    )


@query(
    "should_block",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select id as doc_id, (high or risk >= 0.8 or n > 5) as should_block from doc",
)
def should_block(spark, sf_dir):
    return detection.detect(corpus(spark, sf_dir)).select(
        "doc_id", scoring.should_block(F.col("entities"), F.col("risk_score")).alias("should_block")
    )


@query(
    "block_messages",
    f"with {o.detection_ctes(o.CORPUS_SRC)}, {o.TYPES_CTE} select doc.id as doc_id, {o.BLOCK_MESSAGE} as block_message "
    "from doc left join types on types.id = doc.id",
)
def block_messages(spark, sf_dir):
    return detection.detect(corpus(spark, sf_dir)).select(
        "doc_id", scoring.block_message(F.col("entities"), F.col("risk_score")).alias("block_message")
    )


_POLICY_ROWS = """select
 case when c_custkey % 5 = 0 then 'default_policy' else 'entity_policies' end as section,
 case when c_custkey % 5 = 0 then 'default' else 'TYPE_' || c_custkey end as name,
 case c_custkey % 6 when 0 then 'block' when 1 then 'warn' when 2 then 'mask' when 3 then 'allow' when 4 then 'deny' end as action,
 case c_custkey % 7 when 0 then 'full' when 1 then 'partial' when 2 then 'blur' when 3 then 'hash' end as mask_type,
 case c_custkey % 4 when 0 then '0.5' when 1 then '1.5' when 2 then 'often' end as confidence_threshold
 from {customer}"""


@query(
    "policy_validation",
    f"""with p as ({_POLICY_ROWS.format(customer='customer')}), errors as (
select section, name, case when action is null then case when section = 'default_policy' then 'default_policy missing ''action'' field' else 'Entity policy ''' || name || ''' missing ''action'' field' end
  when action not in ('block', 'warn', 'mask', 'allow') then case when section = 'default_policy' then 'Invalid action in default_policy: ' || action else 'Invalid action for ''' || name || ''': ' || action end end as error from p
union all select section, name, case when section = 'entity_policies' and action = 'mask' and mask_type not in ('full', 'partial', 'synthetic', 'hash', 'redact') then 'Invalid mask_type for ''' || name || ''': ' || mask_type end from p
union all select section, name, case when section = 'entity_policies' and confidence_threshold is not null and not coalesce(try_cast(confidence_threshold as double) between 0 and 1, false) then 'Invalid confidence_threshold for ''' || name || ''': ' || confidence_threshold end from p)
select * from errors where error is not null""",
)
def policy_validation(spark, sf_dir):
    rows = spark.sql(_POLICY_ROWS, customer=table(spark, sf_dir, "customer"))
    return policy_tables.validate_policies(rows)


_UPDATE_ROWS = """select case when c_custkey % 2 = 0 then 'role_overrides' else 'default_policy' end as section,
 'NEW_' || c_custkey as name, 'allow' as action, cast(null as string) as mask_type, '0.1' as confidence_threshold from {customer} where c_custkey % 10 < 3"""


@query(
    "policy_merge",
    f"with p as ({_POLICY_ROWS.format(customer='customer')}), u as ({_UPDATE_ROWS.format(customer='customer')}) "
    "select * from p where section not in (select section from u) union all select * from u",
)
def policy_merge(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return policy_tables.merge_policies(
        spark.sql(_POLICY_ROWS, customer=customer), spark.sql(_UPDATE_ROWS, customer=customer)
    )


@query(
    "default_masking_config",
    f"with p as ({_POLICY_ROWS.format(customer='customer')}) select name as entity_type, coalesce(mask_type, 'full') as mask_type, '*' as mask_char, "
    "coalesce(try_cast(confidence_threshold as double), 0.8::double) as confidence_threshold from p where section = 'entity_policies' and action = 'mask' "
    "union all select 'DEFAULT', 'full', '*', 0.8::double",
)
def default_masking_config(spark, sf_dir):
    rows = spark.sql(_POLICY_ROWS, customer=table(spark, sf_dir, "customer"))
    return policy_tables.default_masking_config(rows)


# --- sanitize and outbound


def _sanitize_sql(src: str, key: str) -> str:
    return (
        f"with {o.sanitize_ctes(src)} select id as {key}, action as action_taken, sanitized as sanitized_text, "
        "blocked_reason from out"
    )


@query("sanitize_corpus", _sanitize_sql(o.CORPUS_SRC, "doc_id"))
def sanitize_corpus(spark, sf_dir):
    return sanitizing.sanitize(corpus(spark, sf_dir)).select("doc_id", "action_taken", "sanitized_text", "blocked_reason")


@query("sanitize_pages", _sanitize_sql(o.PAGES_SRC, "page_id"))
def sanitize_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return sanitizing.sanitize(df).select("page_id", "action_taken", "sanitized_text", "blocked_reason")


@query(
    "sanitize_warnings",
    f"with {o.decision_ctes(o.CORPUS_SRC, external=_EXTERNAL_CTE)} select dec.id as doc_id, ord::int as ord, 'PII detected: ' || typ as warning "
    "from dec join ent on ent.id = dec.id where action = 'warn'",
)
def sanitize_warnings(spark, sf_dir):
    out = sanitizing.sanitize(_with_external(spark, sf_dir), external_col="external_spans")
    return out.select("doc_id", F.posexplode("warnings").alias("ord", "warning")).withColumn("ord", F.col("ord") + 1)


def _outbound_sql(src: str) -> str:
    return (
        f"with {o.decision_ctes(src)}, {o.spliced_cte('spl', o.mask_sql('redact'))}, {o.TYPES_CTE} "
        "select doc.id as doc_id, case when trim(doc.text) = '' or length(doc.text) > 10000 then 'invalid_length' when action = 'block' then 'blocked' else 'ok' end as status, "
        "case when trim(doc.text) = '' or length(doc.text) > 10000 or action = 'block' then null else masked end as sent_text, "
        "coalesce(types, '') as detected_entity_types, n as detected_entity_count, risk as risk_score "
        "from doc join dec on dec.id = doc.id join spl on spl.id = doc.id left join types on types.id = doc.id"
    )


def _outbound(df: DataFrame) -> DataFrame:
    return sanitizing.prepare_outbound(df).select(
        "doc_id", "status", "sent_text",
        F.array_join("detected_entity_types", ", ").alias("detected_entity_types"),
        "detected_entity_count", "risk_score",
    )


@query("outbound_ready", _outbound_sql(o.DOCUMENTS_SRC))
def outbound_ready(spark, sf_dir):
    return _outbound(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("outbound_corpus", _outbound_sql(o.CORPUS_SRC))
def outbound_corpus(spark, sf_dir):
    return _outbound(corpus(spark, sf_dir))


@query(
    "output_scan",
    f"with {o.detection_ctes(o.DOCUMENTS_SRC)}, {o.spliced_cte('spl', o.mask_sql('redact'))} select spl.id as doc_id, masked as redacted_text, n as total_entities "
    "from spl join doc on doc.id = spl.id",
)
def output_scan(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sanitizing.scan_output(df).select("doc_id", "redacted_text", F.size("entities").alias("total_entities"))
