"""Registered queries over bodies, batches, audit events, metrics, access rights and log records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import calibration as cal, protect, redaction, spans
from maskwright.operators import access, batch, detect as detection, external, metrics, payload, sanitize as sanitizing, semantic
from maskwright.plans import oracle as o
from maskwright.plans.catalog import query
from maskwright.plans.corpus import corpus, events, table
from maskwright.sources import audit, texts as text_io
from maskwright.sources.folders import new_folder, written

# --- bodies

# One request or response body per templated text; texts hold no quotes or backslashes.
_SERVICE = "case doc_id % 4 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'google' else 'unknown' end"
_PAYLOAD = """case doc_id % 4 when 0 then '{"model":"m1","temperature":0.50,"messages":[{"role":"user","content":"' || text || '"}],"prompt":"' || text || '","input":["note ' || text || '",5,{"a":"' || text || '"},"plain"]}'
  when 1 then '{"content":["' || text || '",null,true],"max_tokens":100,"system":"' || text || '"}'
  when 2 then '[{"text":"' || text || '"},{"contents":"hello ' || text || '","text":["' || text || '"]}]'
  else '{"prompt":"' || text || '"}' end"""
# Some bodies are no JSON: a repeated key, a broken end, nothing at all.
_BROKEN = """case doc_id % 11 when 3 then '{"prompt":"' || text || '","prompt":"' || text || '"}' when 5 then '{"prompt":"' || text when 7 then null else payload end"""
_INVALID_SQL = "b.doc_id % 11 in (3, 5, 7)"
_TARGETS = """select doc_id, case doc_id % 5 when 0 then 'https://api.openai.com/v1/x/' when 1 then 'https://api.anthropic.com/v1/y/'
 when 2 then 'https://generativelanguage.googleapis.com/z/' when 3 then 'http://proxy/?u=https://api.openai.com' else 'https://other.example/' end || doc_id as url from ({corpus})"""
_BODIES_SQL = f"select doc_id, text, {_SERVICE} as service, {_PAYLOAD} as payload from ({o.CORPUS})"


def bodies(spark, sf_dir) -> DataFrame:
    return corpus(spark, sf_dir).selectExpr(
        "doc_id", "text", f"{_SERVICE} as service", f"{_PAYLOAD} as payload"
    )


@query(
    "service_of_url",
    f"select doc_id, case when contains(url, 'https://api.openai.com') then 'openai' when contains(url, 'https://api.anthropic.com') then 'anthropic' "
    f"when contains(url, 'https://generativelanguage.googleapis.com') then 'google' end as service from ({_TARGETS.format(corpus=o.CORPUS)})",
)
def service_of_url(spark, sf_dir):
    targets = spark.sql(_TARGETS.format(corpus="{c}"), c=corpus(spark, sf_dir))
    return targets.select("doc_id", payload.service_of_url(F.col("url")).alias("service"))


# The texts a body holds, in order, written out from how _BODIES builds them.
_BODY_TEXTS_SQL = f"""btexts as (select doc_id, service, unnest(l) as text, generate_subscripts(l, 1)::int as ord from (
 select doc_id, service, case service when 'openai' then [text, 'note ' || text, 'plain'] when 'anthropic' then [text]
  when 'google' then ['hello ' || text, text, text] else []::varchar[] end as l from ({_BODIES_SQL})))"""


@query("payload_texts", f"with {_BODY_TEXTS_SQL} select doc_id, ord, text from btexts")
def payload_texts(spark, sf_dir):
    keyed = bodies(spark, sf_dir)
    keys = payload.service_keys(F.col("service"), "content_paths")
    found = payload.payload_texts(F.col("payload"), keys)
    return keyed.select("doc_id", F.posexplode(found).alias("ord", "text")).withColumn("ord", F.col("ord") + 1)


def _body_ctes(masked_when: str) -> str:
    """One detection row per body text, and the replacement of each."""
    src = f"with {_BODY_TEXTS_SQL} select doc_id * 10 + ord as id, text from btexts"
    return (
        f"{_BODY_TEXTS_SQL}, {o.sanitize_ctes(src)}, "
        "rep as (select b.doc_id, b.ord, b.text, b.service, out.action, out.n, "
        f"case when {masked_when} then out.masked else b.text end as replacement "
        "from btexts b join out on out.id = b.doc_id * 10 + b.ord), "
        "per as (select doc_id, bool_or(action = 'block') as blocked, sum(n) as n, "
        "max(case when ord = 1 then replacement end) as r1, max(case when ord = 2 then replacement end) as r2, "
        "max(case when ord = 3 then replacement end) as r3, "
        "arg_min(n, ord) filter (action = 'block') as first_blocked_n from rep group by doc_id)"
    )


# Numbers come out in their shortest form, as from any JSON writer.
_REBUILT_SQL = """case service when 'openai' then '{"model":"m1","temperature":' || case when r1 = text and r2 = 'note ' || text then '0.50' else '0.5' end || ',"messages":[{"role":"user","content":"' || text || '"}],"prompt":"' || r1 || '","input":["' || r2 || '",5,{"a":"' || text || '"},"' || r3 || '"]}'
  when 'anthropic' then '{"content":["' || r1 || '",null,true],"max_tokens":100,"system":"' || text || '"}'
  when 'google' then '[{"text":"' || r2 || '"},{"contents":"' || r1 || '","text":["' || r3 || '"]}]' else payload end"""


@query(
    "sanitize_payloads",
    f"with {_body_ctes("out.action = 'mask'")} select b.doc_id, b.service, case when {_INVALID_SQL} then 'invalid' when coalesce(blocked, false) then 'blocked' else 'ok' end as status, "
    f"case when {_INVALID_SQL} or coalesce(blocked, false) then null else {_REBUILT_SQL} end as sanitized_payload, "
    f"case when {_INVALID_SQL} then 0 else coalesce(case when blocked then first_blocked_n else n end, 0)::int end as detected_entities, (not {_INVALID_SQL} and not coalesce(blocked, false) and coalesce(n, 0) > 0) as sanitization_applied "
    f"from ({_BODIES_SQL}) b left join per on per.doc_id = b.doc_id",
)
def sanitize_payloads(spark, sf_dir):
    return payload.sanitize_payload(bodies(spark, sf_dir).withColumn("payload", F.expr(_BROKEN))).select(
        "doc_id", "service", "status", "sanitized_payload", F.size("detected_entities").alias("detected_entities"), "sanitization_applied"
    )


# A response's texts: one under a top-level key of each service.
_RESPONSE = """case service when 'openai' then '{"id":"' || doc_id || '","choices":["' || text || '",{"message":"' || text || '"}],"usage":{"total":12}}'
 when 'anthropic' then '{"content":"' || text || '","stop":null}'
 when 'google' then '{"candidates":["x ' || text || '"],"text":"' || text || '"}' else '{"content":"' || text || '"}' end"""
_RESPONSES_SQL = f"select doc_id, text, service, {_RESPONSE} as payload from ({_BODIES_SQL})"
_RESPONSE_REBUILT = """case b.service when 'openai' then '{"id":"' || b.doc_id || '","choices":["' || r1 || '",{"message":"' || b.text || '"}],"usage":{"total":12}}'
 when 'anthropic' then '{"content":"' || r1 || '","stop":null}' when 'google' then '{"candidates":["' || r2 || '"],"text":"' || r1 || '"}' else payload end"""
_RESPONSE_SRC = (
    f"select doc_id * 10 + 1 as id, text from ({_BODIES_SQL}) union all "
    f"select doc_id * 10 + 2, 'x ' || text from ({_BODIES_SQL})"
)


@query(
    "sanitize_responses",
    f"with {o.sanitize_ctes(_RESPONSE_SRC)}, rep as (select id // 10 as doc_id, id % 10 as ord, case when action in ('block', 'mask') "
    "then masked else text end as r, action, n from out), per as (select doc_id, max(case when ord = 1 then r end) as r1, max(case when ord = 2 then r end) as r2 from rep group by doc_id) "
    f"select b.doc_id, b.service, case when {_INVALID_SQL} then 'invalid' else 'ok' end as status, case when not {_INVALID_SQL} then {_RESPONSE_REBUILT} end as sanitized_payload from ({_RESPONSES_SQL}) b join per on per.doc_id = b.doc_id",
)
def sanitize_responses(spark, sf_dir):
    responses = bodies(spark, sf_dir).withColumn("payload", F.expr(_RESPONSE)).withColumn("payload", F.expr(_BROKEN))
    return payload.sanitize_response(responses).select("doc_id", "service", "status", "sanitized_payload")


_TURN_TEXT = "text || case when conv_id % 5 = 0 and turn = 1 then ' my card 4532-1234-5678-9012' when conv_id % 3 = 0 then ' mail me at a' || conv_id || '@x.org' else '' end"


def _conversations(spark, sf_dir, marked: bool) -> DataFrame:
    text = F.expr(_TURN_TEXT) if marked else F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def _summary_sql(text: str) -> str:
    return (
        f"with {o.decision_ctes(f'select conv_id * 1000 + turn as id, {text} as text from conversations')} "
        "select doc.id // 1000 as conv_id, count(*) as turns, sum(n)::bigint as total_entities, count(*) filter (action = 'mask') as masked_turns, "
        "count(*) filter (action = 'block') as blocked_turns, bool_or(action = 'block') as rejected from doc join dec on dec.id = doc.id group by 1"
    )


@query("conversation_summary", _summary_sql("text"))
def conversation_summary(spark, sf_dir):
    return payload.conversation_summary(_conversations(spark, sf_dir, marked=False))


@query("conversation_summary_marked", _summary_sql(_TURN_TEXT))
def conversation_summary_marked(spark, sf_dir):
    return payload.conversation_summary(_conversations(spark, sf_dir, marked=True))


@query(
    "sanitize_conversations",
    f"with {o.sanitize_ctes(f'select conv_id * 1000 + turn as id, {_TURN_TEXT} as text from conversations')}, "
    "flag as (select *, bool_or(action = 'block') over (partition by id // 1000) as rejected from out) "
    "select id // 1000 as conv_id, id % 1000 as turn, action as action_taken, rejected, case when rejected then null else sanitized end as sanitized_text from flag",
)
def sanitize_conversations(spark, sf_dir):
    return payload.sanitize_conversations(_conversations(spark, sf_dir, marked=True)).drop("text")


# --- batches, reuse, averages


@query(
    "explode_requests",
    f"select doc_id as request_id, (ord - 1)::int as position, text from (select doc_id, unnest(l) as text, generate_subscripts(l, 1) as ord from "
    f"(select doc_id, [text, 'copy ' || text, null] as l from ({o.CORPUS})))",
)
def explode_requests(spark, sf_dir):
    requests = corpus(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"),
        F.array(F.col("text"), F.concat(F.lit("copy "), F.col("text")), F.lit(None).cast("string")).alias("texts"),
    )
    return batch.explode_requests(requests)


def _with_failing(spark, sf_dir, name: str) -> DataFrame:
    """All documents, and a row without text for each benchmark item."""
    failing = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit("src0").alias(name))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias(name), "text").unionByName(
        failing.withColumn("text", F.lit(None).cast("string"))
    )


_FAILING_SRC = f"{o.DOCUMENTS_SRC} union all select -1 - item_id, null from benchmark"


@query(
    "batch_summary",
    f"with {o.detection_ctes(_FAILING_SRC)}, q as (select coalesce(d.source, 'src0') as source, n, high, d.doc_id is null as failed from doc left join documents d on d.doc_id = doc.id) "
    "select source as request_id, count(*) as total_texts_processed, sum(n)::bigint as total_entities_detected, count(*) filter (high) as high_risk_texts, "
    "count(*) filter (failed) as failed_texts, ceil(count(*) / 10.0)::bigint as batches_processed, "
    "count(*)::double / ceil(count(*) / 10.0)::double as average_batch_size from q group by source",
)
def batch_summary(spark, sf_dir):
    return batch.batch_summary(_with_failing(spark, sf_dir, "request_id"))


@query(
    "batch_results",
    f"with {o.detection_ctes(_FAILING_SRC)} select id as doc_id, n as total_entities, risk as risk_score, high as has_high_risk_pii, case when text is null then 'text is missing' end as error from doc",
)
def batch_results(spark, sf_dir):
    """Every text's own result, and the error of those that failed."""
    found = batch.batch_results(_with_failing(spark, sf_dir, "request_id"))
    return found.select("doc_id", F.size("entities").alias("total_entities"), "risk_score", "has_high_risk_pii", "error")


_REUSE_SQL = """with recursive t as (select event_type as key, epoch_us(ts) as t from events),
pos as (select key, t, row_number() over (partition by key order by t) as rn from t),
walk as (select key, t, rn, t as since, 1 as misses from pos where rn = 1
 union all select p.key, p.t, p.rn, case when p.t >= w.since + {ttl} then p.t else w.since end,
  w.misses + case when p.t >= w.since + {ttl} then 1 else 0 end from walk w join pos p on p.key = w.key and p.rn = w.rn + 1),
fin as (select key, max(rn) as requests, max(misses) as misses from walk group by key)"""
_REUSE_COLUMNS = "key, requests::bigint as requests, misses::bigint as misses, (requests - misses)::bigint as hits, (requests - misses) / requests::double as hit_rate"


@query("reuse_accounting", f"{_REUSE_SQL.format(ttl=1800 * 1000000)} select {_REUSE_COLUMNS} from fin")
def reuse_accounting(spark, sf_dir):
    return batch.reuse_accounting(events(spark, sf_dir).withColumnRenamed("event_type", "key"), "key")


@query("reuse_accounting_split", f"{_REUSE_SQL.format(ttl=3600 * 1000000)} select {_REUSE_COLUMNS} from fin")
def reuse_accounting_split(spark, sf_dir):
    """The same with every key's time line split over tasks, and the masking TTL."""
    return batch.reuse_accounting(
        events(spark, sf_dir).withColumnRenamed("event_type", "key"), "key", ttl_seconds=batch.MASKING_TTL_SECONDS, max_times=100
    )


@query(
    "detect_distinct",
    f"with {o.detection_ctes(_FAILING_SRC)} select id as doc_id, n as total_entities, risk as risk_score, high as has_high_risk_pii from doc",
)
def detect_distinct(spark, sf_dir):
    return batch.detect_distinct(_with_failing(spark, sf_dir, "source"), ["doc_id"]).select(
        "doc_id", F.size("entities").alias("total_entities"), "risk_score", "has_high_risk_pii"
    )


_EMA_SQL = """select event_type as key, count(*) as n, round(list_reduce(list(value order by ts, event_id), lambda a, b: 0.1::double * b + 0.9::double * a), 6) as ema
 from events group by event_type"""


@query("ema", _EMA_SQL)
def ema(spark, sf_dir):
    out = batch.ema(events(spark, sf_dir).withColumnRenamed("event_type", "key"), "key", ["ts", "event_id"], "value")
    return out.select("key", "n", F.round("ema", 6).alias("ema"))


@query(
    "perf_stats",
    f"{_REUSE_SQL.format(ttl=1800 * 1000000)}, e as ({_EMA_SQL}) select {_REUSE_COLUMNS.replace('key,', 'fin.key,', 1)}, ema as avg_processing_time_ms from fin join e on e.key = fin.key",
)
def perf_stats(spark, sf_dir):
    out = batch.perf_stats(
        events(spark, sf_dir).withColumnRenamed("event_type", "key"), "key", "ts", ["ts", "event_id"], "value"
    )
    return out.withColumn("avg_processing_time_ms", F.round("avg_processing_time_ms", 6))


# --- audit events and reports

# Events as requests: what each kind records, derived from the event row.
_REQUEST_FIELDS = {
    "detection": [
        "cast(floor(value * 10) as int) as text_length",
        "cast(user_id % 7 as int) as entities_detected",
        "value / 500 as risk_score",
        "value as processing_time_ms",
    ],
    "masking": [
        "cast(user_id % 4 as int) as entities_masked",
        "value as processing_time_ms",
        "cast(null as string) as masking_methods",
    ],
    "sanitization": [
        "case event_type when 'error' then 'block' when 'click' then 'mask' else 'allow' end as action_taken",
        "'default' as policy_name",
        "case user_id % 3 when 0 then 'admin' when 1 then 'user' else 'analyst' end as user_role",
        "cast(user_id % 7 as int) as entities_detected",
        "value / 500 as risk_score",
        "value as processing_time_ms",
        "case when event_type = 'error' then 'blocked for ' || user_id end as blocked_reason",
    ],
    "proxy": [
        "'https://api.openai.com/' || user_id as target_url",
        "'openai' as service",
        "cast(user_id % 7 as int) as entities_detected",
        "user_id % 7 > 0 as sanitization_applied",
        "'request_completed' as action",
        "case when event_type = 'error' then 500 else 200 end as status_code",
        "value as processing_time_ms",
    ],
    "request": [
        "case when event_type = 'view' then 'GET' else 'POST' end as method",
        "'/' || event_type as path",
        "cast(null as string) as user_agent",
    ],
    "response": [
        "case when event_type = 'error' then 500 else 200 end as status_code",
        "value as processing_time_ms",
    ],
    "error": [
        "event_type || '_error' as error_type",
        "'user ' || user_id as error_message",
        "props as context",
        "value as processing_time_ms",
        "'/' || event_type as request_path",
    ],
    "admin": [
        "'policy_update' as action",
        "event_type as updated_policies",
    ],
}


def _request_columns(kind: str) -> list[str]:
    return [
        "cast(event_id as string) as request_id", "cast(user_id as string) as user_id", "ts", *_REQUEST_FIELDS[kind],
    ]


def request_events(spark, sf_dir, kind: str) -> DataFrame:
    """Audit rows of one kind for all events."""
    rows = events(spark, sf_dir).selectExpr(*_request_columns(kind))
    return audit.audit_events(rows, kind, extra_details=["updated_policies"] if kind == "admin" else None)


_DETAIL_FIELDS = {k: [*f, *(["updated_policies"] if k == "admin" else [])] for k, (_, f) in audit.EVENT_KINDS.items()}
_NUMBERS = {"risk_score": "double", "processing_time_ms": "double", "text_length": "int", "entities_detected": "int", "entities_masked": "int", "status_code": "int", "sanitization_applied": "boolean"}


def _audit_query(kind: str):
    def run(spark, sf_dir):
        details = [
            F.get_json_object("details", f"$.{f}").cast(_NUMBERS.get(f, "string")).alias(f) for f in _DETAIL_FIELDS[kind]
        ]
        return request_events(spark, sf_dir, kind).select(
            "request_id", "user_id", "event_type", F.col("metadata.component").alias("component"),
            F.col("metadata.version").alias("version"), F.date_format("event_date", "yyyy-MM-dd").alias("event_day"),
            *details,
        )

    return run


for _kind, (_component, _fields) in audit.EVENT_KINDS.items():
    query(
        f"audit_{_kind}",
        f"select request_id, user_id, '{_kind}' as event_type, '{_component}' as component, '0.1.0' as version, strftime(ts, '%Y-%m-%d') as event_day, "
        f"{', '.join(_DETAIL_FIELDS[_kind])} from (select {', '.join(_request_columns(_kind)).replace(' as string', ' as varchar')} from events)",
    )(_audit_query(_kind))

_START, _END = datetime(2024, 1, 8), datetime(2024, 1, 15, 12)
_RANGE_SQL = "ts between timestamp '2024-01-08 00:00:00' and timestamp '2024-01-15 12:00:00'"


_REPORT_SQL = (
    f"with e as (select user_id % 7 as b, value / 500 as risk from events where {_RANGE_SQL}) "
    "select 'total_detections' as metric, null::int as bucket, round(count(*)::double, 9) as value from e union all select 'average_risk_score', null, round(avg(risk), 9) from e "
    "union all select 'total_documents', null, count(*)::double from e union all select 'entities_distribution', b::int, n::double from (select b, count(*) as n from e group by b)"
)


@query("detection_report", _REPORT_SQL)
def detection_report(spark, sf_dir):
    all_events = audit.union_events(request_events(spark, sf_dir, "detection"), request_events(spark, sf_dir, "sanitization"))
    return audit.detection_report(all_events, _START, _END).withColumn("value", F.round("value", 9))


@query(
    "blocked_report",
    "select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, 'blocked for ' || user_id as reason, case user_id % 3 when 0 then 'admin' when 1 then 'user' else 'analyst' end as user_role, "
    f"value / 500 as risk_score, (user_id % 7)::int as entities_detected from events where event_type = 'error' and {_RANGE_SQL}",
)
def blocked_report(spark, sf_dir):
    all_events = audit.union_events(request_events(spark, sf_dir, "sanitization"), request_events(spark, sf_dir, "response"))
    return audit.blocked_report(all_events, _START, _END).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "reason", "user_role", "risk_score", "entities_detected"
    )


@query(
    "audit_files",
    "select strftime(ts, '%Y-%m-%d') as event_day, 'detection' as event_type, count(*) as events, sum((user_id % 7))::bigint as entities from events group by 1",
)
def audit_files(spark, sf_dir):
    """JSON lines written per day and read back."""
    path = new_folder(spark, "audit")
    audit.write_audit(request_events(spark, sf_dir, "detection"), f"{path}/events")
    back = spark.read.schema(
        "event_type string, details struct<entities_detected:int>, event_date date"
    ).json(f"{path}/events")
    return back.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_day"), "event_type").agg(
        F.count("*").alias("events"), F.sum("details.entities_detected").alias("entities")
    )


@query(
    "write_findings",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select id as doc_id, typ as type, txt as matched_text, c as confidence, s as start_pos, e as end_pos from ent where c >= 0.8",
)
def write_findings(spark, sf_dir):
    path = new_folder(spark, "findings")
    text_io.write_findings(detection.detect(corpus(spark, sf_dir)).drop("text"), f"{path}/out")
    back = spark.read.schema("doc_id long, type string, matched_text string, confidence double, start int, end int").json(f"{path}/out")
    return back.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query("read_texts", "select doc_id, lang, length(text) as characters from documents")
def read_texts(spark, sf_dir):
    texts = text_io.read_texts(spark, f"{sf_dir}/documents.parquet", "parquet")
    return texts.select("doc_id", "lang", F.length("text").cast("long").alias("characters"))


@query(
    "write_masked",
    f"with {o.detection_ctes(o.CORPUS_SRC)}, {o.spliced_cte('spl', o.mask_sql('partial'))} select id as doc_id, masked as masked_text from spl",
)
def write_masked(spark, sf_dir):
    """Masked texts written without the originals and read back."""
    path = new_folder(spark, "masked")
    text_io.write_masked(sanitizing.mask_uniform(corpus(spark, sf_dir)), f"{path}/out")
    return spark.read.parquet(f"{path}/out").select("doc_id", "masked_text")


@query(
    "write_report",
    _REPORT_SQL,
)
def write_report(spark, sf_dir):
    """A report written as JSON and read back."""
    path = new_folder(spark, "report")
    text_io.write_report(audit.detection_report(request_events(spark, sf_dir, "detection"), _START, _END), f"{path}/out")
    back = spark.read.schema("metric string, bucket int, value double").json(f"{path}/out")
    return back.withColumn("value", F.round("value", 9))


# --- metrics

_REQUEST_LABELS = [
    "case when event_type = 'view' then 'GET' else 'POST' end as method",
    "'/' || event_type as endpoint",
    "case when event_type = 'error' then 500 else 200 end as status_code",
    "value / 50 as duration",
]
_REQUESTS_SQL = f"select {', '.join(_REQUEST_LABELS)} from events"


def _requests(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).selectExpr("ts", *_REQUEST_LABELS)


@query(
    "request_counter",
    f"select method, endpoint, status_code::varchar as status_code, count(*) as value from ({_REQUESTS_SQL}) group by 1, 2, 3",
)
def request_counter(spark, sf_dir):
    return metrics.request_counter(_requests(spark, sf_dir))


def _histogram_sql(src: str, labels: list[str], value: str, bounds: list[float]) -> str:
    les = ", ".join(f"('{b}', {b}::double)" for b in bounds) + ", ('+Inf', 'infinity'::double)"
    names = ", ".join(labels)
    return (
        f"with x as ({src}), series as (select {names}, count(*) as series_count, round(sum({value}), 6) as series_sum from x group by all), "
        f"les(le, bound) as (values {les}), hits as (select {names}, le, count(*) as bucket_count from x, les where {value} <= bound group by all) "
        f"select {', '.join('series.' + n for n in labels)}, les.le, coalesce(bucket_count, 0) as bucket_count, series_sum, series_count "
        f"from series cross join les left join hits on {' and '.join(f'hits.{n} = series.{n}' for n in labels)} and hits.le = les.le"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("series_sum", F.round("series_sum", 6))


@query(
    "duration_histogram",
    _histogram_sql(_REQUESTS_SQL, ["method", "endpoint"], "duration", metrics.REQUEST_DURATION_BUCKETS),
)
def duration_histogram(spark, sf_dir):
    return _rounded(metrics.request_duration(_requests(spark, sf_dir)))


@query(
    "detection_duration_histogram",
    _histogram_sql("select event_type as detection_method, value / 250 as duration from events", ["detection_method"], "duration", metrics.DETECTION_DURATION_BUCKETS),
)
def detection_duration_histogram(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_type as detection_method", "value / 250 as duration")
    return _rounded(metrics.detection_duration(rows))


@query(
    "masking_duration_histogram",
    _histogram_sql("select event_type as mask_type, value / 1000 as duration from events", ["mask_type"], "duration", metrics.MASKING_DURATION_BUCKETS),
)
def masking_duration_histogram(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_type as mask_type", "value / 1000 as duration")
    return _rounded(metrics.masking_duration(rows))


def _detected_documents(spark, sf_dir) -> DataFrame:
    return detection.detect(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query(
    "detection_counter",
    f"with {o.detection_ctes(o.DOCUMENTS_SRC)} select typ as entity_type, case when c >= 0.9 then 'high' when c >= 0.7 then 'medium' else 'low' end as confidence_level, count(*) as value from ent group by 1, 2",
)
def detection_counter(spark, sf_dir):
    return metrics.detection_counter(_detected_documents(spark, sf_dir))


@query(
    "confidence_histogram",
    _histogram_sql(f"with {o.detection_ctes(o.DOCUMENTS_SRC)} select typ as entity_type, c as confidence from ent", ["entity_type"], "confidence", metrics.CONFIDENCE_BUCKETS),
)
def confidence_histogram(spark, sf_dir):
    return _rounded(metrics.confidence_histogram(_detected_documents(spark, sf_dir)))


@query(
    "mask_counter",
    f"with {o.detection_ctes(o.DOCUMENTS_SRC)} select case when typ in ('EMAIL', 'PHONE_NUMBER') then 'partial' else 'full' end as mask_type, typ as entity_type, count(*) as value from ent group by 1, 2",
)
def mask_counter(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return metrics.masking_counter(sanitizing.mask(df))


def _decisions(spark, sf_dir) -> DataFrame:
    role = F.when(F.col("doc_id") % 3 == 0, F.lit("admin")).when(F.col("doc_id") % 3 == 1, F.lit("user")).otherwise(F.lit("analyst"))
    decided = sanitizing.evaluate_policy(_detected_documents(spark, sf_dir).withColumn("user_role", role), role=F.col("user_role"))
    return decided.select(F.col("decision.action").alias("action"), F.lit("default").alias("policy_name"), "user_role")


_ROLE_SQL = "case dec.id % 3 when 0 then 'admin' when 1 then 'user' else 'analyst' end"


@query(
    "decision_counter",
    f"with {o.decision_ctes(o.DOCUMENTS_SRC)} select action, 'default' as policy_name, {_ROLE_SQL} as user_role, count(*) as value from dec group by all",
)
def decision_counter(spark, sf_dir):
    return metrics.decision_counter(_decisions(spark, sf_dir))


@query(
    "blocked_counter",
    f"with {o.decision_ctes(o.DOCUMENTS_SRC)} select 'policy_violation' as block_reason, {_ROLE_SQL} as user_role, count(*) as value from dec where action = 'block' group by all",
)
def blocked_counter(spark, sf_dir):
    return metrics.blocked_counter(_decisions(spark, sf_dir))


@query(
    "error_counter",
    "select event_type || '_error' as error_type, 'component_' || (user_id % 3) as component, count(*) as value from events group by 1, 2",
)
def error_counter(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_type || '_error' as error_type", "'component_' || (user_id % 3) as component")
    return metrics.error_counter(rows)


@query(
    "high_risk_counter",
    f"with {o.detection_ctes(o.DOCUMENTS_SRC)} select typ as entity_type, source, count(*) as value from ent join documents d on d.doc_id = ent.id where typ in {o.HIGH} group by all",
)
def high_risk_counter(spark, sf_dir):
    return metrics.high_risk_counter(_detected_documents(spark, sf_dir))


@query(
    "cache_counter",
    "select case when event_type = 'view' then 'get' else 'set' end as operation, 'type_' || (user_id % 2) as cache_type, case when value < 100 then 'hit' else 'miss' end as result, count(*) as value from events group by 1, 2, 3",
)
def cache_counter(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr(
        "case when event_type = 'view' then 'get' else 'set' end as operation", "'type_' || (user_id % 2) as cache_type",
        "case when value < 100 then 'hit' else 'miss' end as result",
    )
    return metrics.cache_counter(rows)


@query("cache_hit_rate", "select event_type as cache_type, arg_max(value / 500, row(ts, value / 500)) as hit_rate from events group by 1")
def cache_hit_rate(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_type as cache_type", "value / 500 as hit_rate", "ts")
    return metrics.cache_hit_rate(rows)


_RATES_SQL = """rates as (select date_trunc('hour', ts) as w, count(*) as n, count(*) filter (event_type = 'error') / count(*)::double as error_rate,
 avg(value / 50) as avg_response_time from events group by 1),
states as (select 'high_error_rate' as rule, 'critical' as severity, w, error_rate as value, error_rate > 0.05 as hit from rates
 union all select 'high_response_time', 'warning', w, avg_response_time, avg_response_time > 2.0 from rates),
moved as (select *, coalesce(lag(hit) over (partition by rule order by w), false) as was from states)"""


@query(
    "alert_transitions",
    f"with {_RATES_SQL} select rule, severity, strftime(w, '%Y-%m-%d %H:%M:%S') as at, round(value, 9) as value, case when hit then 'active' else 'resolved' end as status from moved where hit <> was",
)
def alert_transitions(spark, sf_dir):
    rates = metrics.windowed_rates(events(spark, sf_dir), F.col("event_type") == "error", F.col("value") / 50)
    return metrics.alert_transitions(rates).select(
        "rule", "severity", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("value", 9).alias("value"), "status"
    )


@query(
    "blocked_per_hour",
    "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as at, count(*) as blocked from events where event_type = 'error' group by 1 having count(*) > 4",
)
def blocked_per_hour(spark, sf_dir):
    found = metrics.blocked_alerts(events(spark, sf_dir), F.col("event_type") == "error", threshold=4)
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), "blocked")


# --- access rights

_USERS = """select c_custkey as user_id, c_name as username, lower(c_mktsegment) || c_custkey || '@example.com' as email, c_custkey % 11 <> 0 as is_active,
 case c_custkey % 8 when 0 then 'guest' when 1 then 'user' when 2 then 'analyst' when 3 then 'developer' when 4 then 'security_officer'
  when 5 then 'team_' || (c_custkey % 40) when 6 then 'nosuchrole' when 7 then case when c_custkey % 56 = 7 then 'admin' else 'user' end end as role1,
 case when c_custkey % 3 = 0 then 'user' when c_custkey % 3 = 1 then 'team_' || (c_custkey % 60) end as role2,
 case c_custkey % 9 when 0 then 'export_data' when 1 then 'api_admin' when 2 then 'view_analytics' end as direct from {customer}"""
# Custom roles: one per 20 customers; every third is inactive; none inherits.
_TEAMS = "select 'team_' || c_custkey as role, c_custkey % 3 <> 0 as is_active, case when c_custkey % 2 = 0 then 'manage_roles' else 'system_config' end as p from {customer} where c_custkey % 20 = 0"


def users(spark, sf_dir) -> DataFrame:
    rows = spark.sql(_USERS, customer=table(spark, sf_dir, "customer"))
    none = F.array().cast("array<string>")
    return rows.select(
        "user_id", "username", "email", "is_active",
        F.array_distinct(F.array_compact(F.array("role1", "role2"))).alias("roles"),
        F.when(F.col("direct").isNotNull(), F.array("direct")).otherwise(none).alias("permissions"),
    )


def roles(spark, sf_dir) -> DataFrame:
    teams = spark.sql(_TEAMS, customer=table(spark, sf_dir, "customer"))
    none = F.array().cast("array<string>")
    return access.default_roles(spark).unionByName(
        teams.select("role", "is_active", F.array("p").alias("permissions"), none.alias("inherits"))
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(o.quoted(v) for v in row) + ")" for row in rows)


_DEFAULT_GRANTS = _values((r, p) for r, ps in access.ROLE_PERMISSIONS.items() for p in ps)
_ANCESTORS = _values((r, a) for r, ancestors in access.ROLE_HIERARCHY.items() for a in ancestors)
_ACCESS_CTES = f"""users as ({_USERS.format(customer='customer')}), teams as ({_TEAMS.format(customer='customer')}),
dg(role, p) as (values {_DEFAULT_GRANTS}), anc(role, parent) as (values {_ANCESTORS}),
roles as (select distinct role, true as is_active from dg union all select role, is_active from teams),
own as (select role, p from dg union all select role, p from teams),
eff as (select role, p from own union select anc.role, dg.p from anc join dg on dg.role = anc.parent),
ur as (select user_id, role1 as role from users where role1 is not null union select user_id, role2 from users where role2 is not null),
up as (select user_id, direct as p from users where is_active and direct is not null
 union select ur.user_id, eff.p from ur join users u on u.user_id = ur.user_id and u.is_active join roles r on r.role = ur.role and r.is_active join eff on eff.role = ur.role)"""


@query(
    "role_permissions",
    f"with {_ACCESS_CTES} select eff.role, p as permission, coalesce(h, 0) as holders from eff left join (select role, count(*) as h from ur group by role) c on c.role = eff.role",
)
def role_permissions(spark, sf_dir):
    """Effective permissions of every role, with the number of users who hold the role."""
    holders = (
        users(spark, sf_dir).select(F.explode("roles").alias("role")).groupBy("role").agg(F.count("*").alias("holders"))
    )
    sets = access.role_permissions(roles(spark, sf_dir)).join(holders, "role", "left")
    return sets.select("role", F.explode("effective").alias("permission"), F.coalesce("holders", F.lit(0)).alias("holders"))


@query("user_permissions", f"with {_ACCESS_CTES} select user_id, p as permission from up")
def user_permissions(spark, sf_dir):
    return access.user_permissions(users(spark, sf_dir), roles(spark, sf_dir))


_ACCESS_REQUESTS = """select event_id as request_id, user_id * 17 % 2000 as user_id, ts,
 case event_id % 6 when 0 then 'detect_pii' when 1 then 'export_data' when 2 then 'view_detection_results' when 3 then 'manage_roles' when 4 then 'edit_policies' else 'api_admin' end as permission,
 case when event_id % 4 < 2 then 'user' else 'report' end as resource_type,
 cast(user_id * 17 % 2000 + case when event_id % 8 = 0 then 1 else 0 end as string) as resource_id from {events}"""
_AUTHORIZED_CTES = f"""{_ACCESS_CTES}, req as ({_ACCESS_REQUESTS.format(events='events')}),
authd as (select req.*, case when u.user_id is null then 'user_not_found' when not u.is_active then 'user_inactive' when d.p is not null then 'permission' when a.p is not null then 'admin_override'
 when resource_type = 'user' and resource_id = req.user_id::varchar and permission in ('view_detection_results', 'export_data') then 'own_resource' else 'denied' end as reason
 from req left join users u on u.user_id = req.user_id left join up d on d.user_id = req.user_id and d.p = req.permission left join up a on a.user_id = req.user_id and a.p = 'api_admin')"""


def _authorized(spark, sf_dir) -> DataFrame:
    requests = spark.sql(_ACCESS_REQUESTS, events=events(spark, sf_dir))
    return access.authorize(requests, users(spark, sf_dir), roles(spark, sf_dir))


@query(
    "authorize",
    f"with {_AUTHORIZED_CTES} select request_id, user_id, permission, reason, reason in ('permission', 'admin_override', 'own_resource') as granted from authd",
)
def authorize(spark, sf_dir):
    return _authorized(spark, sf_dir).select("request_id", "user_id", "permission", "reason", "granted")


@query(
    "last_logins",
    f"with {_AUTHORIZED_CTES} select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_login from authd where reason in ('permission', 'admin_override', 'own_resource') group by 1",
)
def last_logins(spark, sf_dir):
    found = access.last_logins(_authorized(spark, sf_dir))
    return found.select("user_id", F.date_format("last_login", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_login"))


@query(
    "users_with_permission",
    f"with {_ACCESS_CTES} select distinct user_id from up where p in ('view_audit_logs', 'api_admin')",
)
def users_with_permission(spark, sf_dir):
    return access.users_with_permission(users(spark, sf_dir), roles(spark, sf_dir), "view_audit_logs")


@query(
    "access_audit",
    f"with {_ACCESS_CTES} select u.user_id, username, email, is_active, coalesce(role1, '') || '/' || coalesce(case when role2 <> role1 then role2 end, '') as roles, "
    "coalesce(direct, '') as direct_permissions, coalesce(l, '') as total_permissions from users u left join (select user_id, string_agg(p, ',' order by p) as l from up group by user_id) t on t.user_id = u.user_id",
)
def access_audit(spark, sf_dir):
    found = access.access_audit(users(spark, sf_dir), roles(spark, sf_dir))
    second = F.coalesce(F.get("roles", F.lit(1)), F.lit(""))
    return found.select(
        "user_id", "username", "email", "is_active",
        F.concat(F.coalesce(F.get("roles", F.lit(0)), F.lit("")), F.lit("/"), second).alias("roles"),
        F.array_join("direct_permissions", ",").alias("direct_permissions"),
        F.array_join("total_permissions", ",").alias("total_permissions"),
    )


@query(
    "rbac_stats",
    f"with {_ACCESS_CTES} select 'total_users' as statistic, count(*) as value from users union all select 'active_users', count(*) from users where is_active "
    "union all select 'total_roles', count(*) from roles union all select 'active_roles', count(*) from roles where is_active "
    "union all select 'total_permissions', 21 union all select 'role_hierarchy_depth', 5",
)
def rbac_stats(spark, sf_dir):
    return access.rbac_stats(users(spark, sf_dir), roles(spark, sf_dir))


@query("deletable_roles", f"with {_ACCESS_CTES} select role from roles where role not in (select role from ur)")
def deletable_roles(spark, sf_dir):
    return access.deletable_roles(users(spark, sf_dir), roles(spark, sf_dir))


@query("invalid_role_refs", f"with {_ACCESS_CTES} select user_id, role from ur where role not in (select role from roles)")
def invalid_role_refs(spark, sf_dir):
    return access.invalid_role_refs(users(spark, sf_dir), roles(spark, sf_dir))


@query(
    "require_any",
    f"with {_ACCESS_CTES} select u.user_id, coalesce(ok, false) as allowed from users u left join (select user_id, bool_or(p in ('generate_reports', 'system_config', 'api_admin')) as ok from up group by 1) a on a.user_id = u.user_id",
)
def require_any(spark, sf_dir):
    found = access.with_permissions(users(spark, sf_dir), roles(spark, sf_dir))
    return found.select(
        "user_id", access.require_any(F.col("total_permissions"), ["generate_reports", "system_config"]).alias("allowed")
    )


# --- protection and log redaction

_KEY = "0123456789abcdef0123456789abcdef"


@query(
    "encrypt_roundtrip",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select doc.id as doc_id, text as original_text, coalesce(l, '') as quoted, true as all_hidden from doc left join "
    "(select id, string_agg(txt || '/' || context, '|' order by ord) as l from ent group by id) q on q.id = doc.id",
)
def encrypt_roundtrip(spark, sf_dir):
    found = detection.detect(corpus(spark, sf_dir)).withColumn("plain", F.col("text"))
    key = F.lit(_KEY)
    hidden = protect.encrypt_findings(found, key)
    hidden = hidden.withColumn(
        "all_hidden",
        (F.col("text") != F.col("plain"))
        & ~F.exists("entities", lambda e: F.contains(F.col("plain"), e["text"])),
    )
    shown = protect.decrypt_findings(hidden, key)
    quoted = F.array_join(F.transform("entities", lambda e: F.concat(e["text"], F.lit("/"), e["context"])), "|")
    return shown.select("doc_id", F.col("text").alias("original_text"), quoted.alias("quoted"), "all_hidden")


def _redact_sql(text: str) -> str:
    for pattern, label in redaction.LOG_PATTERNS:
        text = f"regexp_replace({text}, {o.quoted(pattern)}, '{label}', 'g')"
    return text


@query("redact_strings", f"select doc_id, {_redact_sql('text')} as redacted from ({o.CORPUS})")
def redact_strings(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", redaction.redact_string(F.col("text")).alias("redacted"))


@query("redact_documents", f"select doc_id, {_redact_sql('text')} as redacted from documents")
def redact_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return df.select("doc_id", redaction.redact_string(F.col("text")).alias("redacted"))


@query(
    "redact_fields",
    f"""select doc_id, {_redact_sql('text')} as note, '[REDACTED]' as user_email, '[REDACTED]' as user_password, {_redact_sql("'api ' || text")} as user_api_key,
 [{_redact_sql('text')}, 'x'][1] as tag, '[REDACTED]' as props_key, {_redact_sql('text')} as props_other, '[REDACTED]' as phone from ({o.CORPUS})""",
)
def redact_fields(spark, sf_dir):
    text = F.col("text")
    records = corpus(spark, sf_dir).select(
        "doc_id",
        text.alias("note"),
        F.struct(
            text.alias("email"),
            F.struct(text.alias("Password"), F.concat(F.lit("api "), text).alias("api_key")).alias("credentials"),
        ).alias("user"),
        F.array(text, F.lit("x")).alias("tags"),
        F.create_map(F.lit("key"), text, F.lit("other"), text).alias("props"),
        F.length(text).alias("Phone"),
    )
    redacted = redaction.redact_fields(records)
    return redacted.select(
        "doc_id", "note",
        F.col("user.email").alias("user_email"),
        F.col("user.credentials.Password").alias("user_password"),
        F.col("user.credentials.api_key").alias("user_api_key"),
        F.col("tags")[0].alias("tag"),
        F.col("props")["key"].alias("props_key"),
        F.col("props")["other"].alias("props_other"),
        F.col("Phone").alias("phone"),
    )


_LEVEL = "case event_id % 6 when 0 then 'DEBUG' when 1 then 'info' when 2 then 'Warning' when 3 then 'error' when 4 then 'critical' else 'trace' end"


@query(
    "redacted_log",
    f"select * from (select event_id, {_LEVEL} as level, 'user ' || user_id as message, '[REDACTED]' as token, '[EMAIL] from ' || user_id as note from events) where lower(level) in ('debug', 'info', 'warning', 'error')",
)
def redacted_log(spark, sf_dir):
    records = events(spark, sf_dir).selectExpr(
        "event_id", f"{_LEVEL} as level", "'user ' || user_id as message", "props as token", "'u' || user_id || '@example.com from ' || user_id as note"
    )
    return redaction.redacted_log(records)


# --- semantic adjustment, calibration, training data

_TYPE_OF_LABEL = "case label when 0 then 'EMAIL' when 1 then 'PHONE_NUMBER' when 2 then 'PERSON' when 3 then 'US_SSN' when 4 then 'CREDIT_CARD' when 5 then 'LOCATION' else 'URL' end"


def _embeddings(spark, sf_dir) -> DataFrame:
    """Embeddings, dealt out: comparing or unpacking a vector takes far longer than reading it."""
    return text_io.dealt(table(spark, sf_dir, "embeddings"), "vec_id")


def _mean_vectors(dims: DataFrame, groups: list[str]) -> DataFrame:
    """One prototype per group of (*groups, i, x): the mean vector. Labels 0-5 are entity types, the others contexts.
    Written, as prototypes are read several times."""
    means = dims.groupBy(*groups, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    prototypes = vectors.select(
        F.when(F.col("label") <= 5, F.lit("pattern")).otherwise(F.lit("context")).alias("kind"),
        F.expr(_TYPE_OF_LABEL).alias("label"),
        F.transform("v", lambda p: p["m"]).alias("embedding"),
    )
    return written(prototypes, "prototypes")


def _centroids(spark, sf_dir) -> DataFrame:
    """One prototype per label."""
    return _mean_vectors(_embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x")), ["label"])


def _vector_spans(spark, sf_dir) -> DataFrame:
    return _embeddings(spark, sf_dir).select(
        "vec_id",
        F.expr(_TYPE_OF_LABEL).alias("entity_type"),
        (F.lit(0.5) + F.pmod("vec_id", F.lit(5)) / 10).alias("confidence"),
        F.concat(F.lit("personal data of "), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 2 == 0, F.lit(" contact details information")).otherwise(F.lit(""))).alias("text"),
        F.lit(0).alias("start"),
        F.lit(8).alias("end"),
        "embedding",
        F.reverse("embedding").alias("context_embedding"),
    )


_SEMANTIC_CTES = f"""dims as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, i, avg(x) as m from dims group by 1, 2), protos as (select label, list(m order by i) as v from means group by 1),
sc as (select vec_id, {_TYPE_OF_LABEL} as entity_type, 0.5::double + (vec_id % 5) / 10.0::double as confidence,
 'personal data of ' || vec_id || case when vec_id % 2 = 0 then ' contact details information' else '' end as text,
 coalesce((select list_cosine_similarity(e.embedding::double[], p.v) from protos p where p.label = e.label and p.label <= 5), 0.5::double) as pattern_similarity,
 greatest(0.0::double, (select max(list_cosine_similarity(list_reverse(e.embedding)::double[], p.v)) from protos p where p.label > 5)) as context_similarity from embeddings e)"""


@query(
    "semantic_scores",
    f"with {_SEMANTIC_CTES} select vec_id, entity_type, round(pattern_similarity, 6) as pattern_similarity, round(context_similarity, 6) as context_similarity from sc",
)
def semantic_scores(spark, sf_dir):
    out = semantic.semantic_scores(_vector_spans(spark, sf_dir), _centroids(spark, sf_dir))
    return out.select(
        "vec_id", "entity_type", F.round("pattern_similarity", 6).alias("pattern_similarity"), F.round("context_similarity", 6).alias("context_similarity")
    )


_RELEVANCE_SQL = "(" + " + ".join(f"contains(lower(context), '{w}')::int" for w in cal.RELEVANCE_WORDS) + ") / 8.0::double"


@query(
    "adjust_confidence",
    f"with {_SEMANTIC_CTES}, rel as (select *, {_RELEVANCE_SQL.replace('context)', 'text)')} as relevance from sc), "
    "boosted as (select *, 0.4::double * pattern_similarity + 0.3::double * context_similarity + 0.3::double * relevance as boost from rel) "
    "select vec_id, relevance as context_relevance, round(least(1.0::double, greatest(0.0::double, case when boost > 0.6 then confidence + (1 - confidence) * 0.2::double when boost < 0.3 then confidence * 0.8::double else confidence end)), 9) as confidence from boosted",
)
def adjust_confidence(spark, sf_dir):
    out = semantic.enhance(_vector_spans(spark, sf_dir), _centroids(spark, sf_dir))
    return out.select("vec_id", "context_relevance", F.round("confidence", 9).alias("confidence"))


def _many_prototypes(spark, sf_dir) -> DataFrame:
    """Some two hundred prototypes of each type and as many contexts: mean vectors of groups of all rows."""
    dims = _embeddings(spark, sf_dir).select(
        "label", F.pmod("vec_id", F.lit(200)).alias("g"), F.posexplode("embedding").alias("i", "x")
    )
    return _mean_vectors(dims, ["label", "g"])


@query(
    "semantic_many_prototypes",
    f"""with dims as (select label, vec_id % 200 as g, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, g, i, avg(x) as m from dims group by 1, 2, 3), protos as (select label, g, list(m order by i) as v from means group by 1, 2),
named as (select *, {_TYPE_OF_LABEL} as typ from protos),
spans as (select vec_id, case when vec_id % 3 = 0 then 'EMAIL' else {_TYPE_OF_LABEL} end as entity_type, list_reverse(embedding)::double[] as own, embedding::double[] as around from embeddings),
pat as (select vec_id, max(list_cosine_similarity(own, v)) as x from spans join named on typ = entity_type and label <= 5 group by 1),
con as (select vec_id, max(list_cosine_similarity(around, v)) as x from spans join named on label > 5 group by 1)
select vec_id, entity_type, round(coalesce(pat.x, 0.5::double), 6) as pattern_similarity, round(greatest(0.0::double, coalesce(con.x, 0)), 6) as context_similarity
from spans left join pat using (vec_id) left join con using (vec_id)""",
)
def semantic_many_prototypes(spark, sf_dir):
    """Similarity to the nearest of hundreds of prototypes of a type; one type has a third of all spans and more."""
    spans = _embeddings(spark, sf_dir).select(
        "vec_id",
        F.when(F.col("vec_id") % 3 == 0, F.lit("EMAIL")).otherwise(F.expr(_TYPE_OF_LABEL)).alias("entity_type"),
        F.reverse("embedding").alias("embedding"),
        F.col("embedding").alias("context_embedding"),
    )
    out = semantic.semantic_scores(spans, _many_prototypes(spark, sf_dir))
    return out.select(
        "vec_id", "entity_type", F.round("pattern_similarity", 6).alias("pattern_similarity"), F.round("context_similarity", 6).alias("context_similarity")
    )


@query(
    "enhance_texts",
    f"""with {o.detection_ctes(o.CORPUS_SRC)}, dims as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, i, avg(x) as m from dims group by 1, 2), protos as (select label, {_TYPE_OF_LABEL} as typ, list(m order by i) as v from means group by 1),
sp as (select ent.id, ord, typ, c, s, e, substring(src.text, greatest(s - 100, 0) + 1, e + 100 - greatest(s - 100, 0)) as context, embedding::double[] as own, list_reverse(embedding)::double[] as around
 from ent join src on src.id = ent.id left join embeddings on vec_id = (ent.id + ord - 1) % (select count(*) from embeddings)),
sims as (select sp.*, coalesce((select max(list_cosine_similarity(own, v)) from protos p where p.typ = sp.typ and label <= 5), 0.5::double) as pattern_similarity,
 greatest(0.0::double, coalesce((select max(list_cosine_similarity(around, v)) from protos p where label > 5), 0)) as context_similarity from sp),
boosted as (select *, 0.4::double * pattern_similarity + 0.3::double * context_similarity + 0.3::double * {_RELEVANCE_SQL} as boost from sims),
adjusted as (select *, least(1.0::double, greatest(0.0::double, case when boost > 0.6 then c + (1 - c) * 0.2::double when boost < 0.3 then c * 0.8::double else c end)) as c2 from boosted)
select src.id as doc_id, coalesce(string_agg(typ || ':' || s || ':' || cast(round(c2 * 1000000) as bigint) || ':' || length(context), ' ' order by ord), '') as entities
from src left join adjusted on adjusted.id = src.id group by src.id""",
)
def enhance_texts(spark, sf_dir):
    """Detected texts whose entities carry the confidence that vectors and context support."""
    detected = written(detection.detect(corpus(spark, sf_dir)).select("doc_id", "text", "entities"), "detected")  # read three times
    embeddings = table(spark, sf_dir, "embeddings")
    places = detected.select("doc_id", F.posexplode("entities").alias("ord", "entity"))
    named = places.withColumn("vec_id", F.pmod(F.col("doc_id") + F.col("ord"), F.lit(max(embeddings.count(), 1))))
    vectors = named.join(embeddings, "vec_id").select("doc_id", "ord", "embedding", F.reverse("embedding").alias("context_embedding"))
    out = semantic.enhance_texts(detected, vectors, _centroids(spark, sf_dir), "doc_id")
    told = F.transform("entities", lambda e: F.concat_ws(
        ":", e["entity_type"], e["start"].cast("string"), F.round(e["confidence"] * 1_000_000).cast("bigint").cast("string"), F.length(e["context"]).cast("string")
    ))
    return out.select("doc_id", F.array_join(told, " ").alias("entities"))


_SHARE_SQL = "(" + " + ".join(f"contains(lower(context), '{w}')::int" for w in cal.CALIBRATION_WORDS) + ") / 4.0::double"
_SUSPICIOUS = o.strings(cal.SUSPICIOUS_WORDS)


def _features_sql(src: str) -> str:
    return f"""{o.detection_ctes(src)}, feat as (select ent.id, ord::int as ord, typ, c as pattern_match_score, {_SHARE_SQL} as context_score,
 case when s / length(text)::double < 0.1 then 0.8::double when s / length(text)::double > 0.9 then 0.6::double else 1.0::double end as position_score,
 case when length(txt) < 3 then 0.3::double when length(txt) > 50 then 0.7::double else 1.0::double end as length_score,
 1.0::double - len(list_filter(words, lambda w: lower(w) in {_SUSPICIOUS})) / greatest(1, len(words))::double as surrounding_text_score
 from (select *, list_filter(regexp_split_to_array(context, '\\s+'), lambda w: w <> '') as words from ent) ent join src on src.id = ent.id)"""


_FEATURES = list(cal.FEATURE_WEIGHTS)
_SCORE_SQL = " + ".join(f"{name} * {weight}::double" for name, weight in cal.FEATURE_WEIGHTS.items())


@query(
    "calibration_features",
    f"with {_features_sql(o.CORPUS_SRC)} select id as doc_id, ord - 1 as ord, {', '.join(_FEATURES)} from feat",
)
def calibration_features(spark, sf_dir):
    out = semantic.span_features(detection.detect(corpus(spark, sf_dir)))
    return out.select("doc_id", "ord", *[F.col(f"features.{n}").alias(n) for n in _FEATURES])


@query(
    "calibrate",
    f"with {_features_sql(o.DOCUMENTS_SRC)} select id as doc_id, ord - 1 as ord, round(1 / (1 + exp(-5 * (({_SCORE_SQL}) - 0.5::double))), 9) as calibrated_confidence from feat",
)
def calibrate(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = semantic.calibrate(semantic.span_features(detection.detect(df)))
    return out.select("doc_id", "ord", F.round("calibrated_confidence", 9).alias("calibrated_confidence"))


def calibration_samples(spark, sf_dir) -> DataFrame:
    """Spans of all documents, labelled by the document's quality."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    features = semantic.span_features(detection.detect(df)).select("doc_id", "features")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return features.join(labels, "doc_id")


_TRAIN_RAW = {n: f"{w}::double * (1 + d_{n} * 0.1::double)" for n, w in cal.FEATURE_WEIGHTS.items()}
_TRAIN_TOTAL = " + ".join(_TRAIN_RAW.values())


@query(
    "train_calibrator",
    f"with {_features_sql(o.DOCUMENTS_SRC)}, st as (select count(*) as samples, "
    + ", ".join(f"abs(avg({n}) filter (quality = 1) - avg({n}) filter (quality = 0)) as d_{n}" for n in _FEATURES)
    + " from feat join labels l on l.doc_id = feat.id) select "
    + ", ".join(
        f"round(case when samples >= 10 and d_pattern_match_score is not null then ({_TRAIN_RAW[n]}) / ({_TRAIN_TOTAL}) else {cal.FEATURE_WEIGHTS[n]}::double end, 9) as {n}" for n in _FEATURES
    )
    + ", samples, samples >= 10 as is_trained from st",
)
def train_calibrator(spark, sf_dir):
    out = semantic.train_calibrator(calibration_samples(spark, sf_dir))
    return out.select(*[F.round(n, 9).alias(n) for n in _FEATURES], "samples", "is_trained")


@query(
    "sentence_context",
    f"""with {o.detection_ctes(o.DOCUMENTS_SRC)}, cut as (select id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '') as l from src),
sent as (select id, unnest(l) as sentence, generate_subscripts(l, 1) as k from cut),
placed2 as (select *, sum(length(sentence) + 1) over (partition by id order by k) - length(sentence) - 1 as at from sent),
hit as (select ent.id, ent.ord, arg_min(sentence, k) as sentence from ent join placed2 p on p.id = ent.id and p.at <= ent.s and ent.s <= p.at + length(p.sentence) group by 1, 2)
select ent.id as doc_id, (ent.ord - 1)::int as ord, coalesce(hit.sentence, ent.context) as sentence, ent.s / length(src.text)::double as position_ratio from ent join src on src.id = ent.id left join hit on hit.id = ent.id and hit.ord = ent.ord""",
)
def sentence_context(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = detection.detect(df).select("doc_id", "text", F.posexplode("entities").alias("ord", "e"))
    text, start, end = F.col("text"), F.col("e.start"), F.col("e.end")
    return rows.select(
        "doc_id", "ord",
        spans.sentence_of_span(text, start, end).alias("sentence"),
        spans.position_ratio(text, start).alias("position_ratio"),
    )


@query(
    "ner_examples",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select doc.id as doc_id, text, coalesce(l, '') as entities from doc left join "
    "(select id, string_agg(s || ':' || e || ':' || typ, ' ' order by ord) as l from ent group by id) x on x.id = doc.id",
)
def ner_examples(spark, sf_dir):
    texts, found = _ner_inputs(spark, sf_dir)
    out = semantic.ner_examples(texts, found, "doc_id", ["ord"])
    parts = F.transform(
        "entities", lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["label"])
    )
    return out.select("doc_id", "text", F.array_join(parts, " ").alias("entities"))


def _ner_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    texts = corpus(spark, sf_dir)
    found = detection.detect(texts).select("doc_id", F.posexplode("entities").alias("ord", "e"))
    return texts, found.select(
        "doc_id", "ord", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.entity_type").alias("label")
    )


@query(
    "ner_readiness",
    f"with {o.detection_ctes(o.CORPUS_SRC)} select case when count(*) >= 50 then 'examples_sufficient' else 'examples_insufficient' end as item, count(*) as value from doc "
    "union all select 'label:' || typ, count(*) from ent group by typ",
)
def ner_readiness(spark, sf_dir):
    texts, found = _ner_inputs(spark, sf_dir)
    return semantic.ner_readiness(semantic.ner_examples(texts, found, "doc_id", ["ord"]))


@query(
    "model_predictions",
    "select c_custkey as doc_id, entity_type, start_pos, end_pos, coalesce(confidence, 0.8::double) as confidence from (select c_custkey, 'PERSON' as entity_type, 0 as start_pos, 4 as end_pos, 0.85::double as confidence from customer where c_custkey % 3 = 0 "
    "union all select c_custkey, 'EMAIL_ADDRESS', 0, 12, 0.95::double from customer where c_custkey % 5 = 1 union all select c_custkey, 'LOCATION', 5, 9, null from customer where c_custkey % 7 = 2)",
)
def model_predictions(spark, sf_dir):
    from maskwright.plans.text_queries import external_rows

    out = external.model_predictions(external_rows(spark, sf_dir))
    return out.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
