"""Masking, policy, bodies, access, protection, redaction and semantic operators on small tables."""

import json
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from maskwright.functions import calibration as cal, masking, protect, redaction, spans
from maskwright.functions.policy import DEFAULT_DOCUMENT, Policy, fallback_document, load_policy
from maskwright.operators import access, batch, external, payload, policies, sanitize as sanitizing, semantic
from maskwright.operators.detect import detect
from maskwright.plans import corpus as corpora
from maskwright.sources import audit, texts as text_io

SF = "/root/testdata/sf0.001"


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_synthetic_values_have_the_right_shape(spark):
    shapes = {
        "EMAIL": r"[a-z]{8}@(example\.com|test\.org|sample\.net|demo\.co)",
        "PHONE_NUMBER": r"555-[1-9]\d{2}-[1-9]\d{3}",
        "PERSON": r"(John|Jane|Alex|Sam|Chris|Jordan) (Smith|Johnson|Williams|Brown|Jones|Garcia)",
        "IP_ADDRESS": r"192\.168\.([1-9]|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])\.([1-9]|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])",
        "CREDIT_CARD": "4000-1234-5678-9012",
        "US_SSN": "000-12-3456",
        "URL": r"\[SYNTHETIC_URL\]",
    }
    rows = [(k, f"value {i}") for k in shapes for i in range(200)]
    df = spark.createDataFrame(rows, "entity_type string, text string")
    span = F.struct("entity_type", "text")
    value = masking.mask_value(span, masking.config_struct({"mask_type": "synthetic"}), seed=1)
    first = [tuple(r) for r in df.select("entity_type", value).collect()]
    assert all(re.fullmatch(shapes[k], v) for k, v in first)
    assert first == [tuple(r) for r in df.repartition(4).sort("entity_type").select("entity_type", value).collect()] or sorted(first) == sorted(tuple(r) for r in df.select("entity_type", value).collect())
    assert len({v for k, v in first if k == "EMAIL"}) > 150


def test_partial_masks(spark):
    cases = [
        ("EMAIL", "john@x.io", "j***@x.io"), ("EMAIL", "a@b", "a@b"), ("EMAIL", "noat", "n**t"),
        ("PHONE_NUMBER", "555-1234", "555**234"), ("PHONE_NUMBER", "12345", "1***5"),
        ("CREDIT_CARD", "4532123456789012", "************9012"), ("US_SSN", "123", "1*3"),
        ("X", "ab", "**"), ("X", "abc", "a*c"), ("X", "", ""),
    ]
    df = spark.createDataFrame(cases, "entity_type string, text string, want string")
    got = df.select("want", masking.mask_value(F.struct("entity_type", "text"), masking.config_struct({"mask_type": "partial"})).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_unknown_mask_type_is_an_error(spark):
    with pytest.raises(ValueError):
        masking.config_map({"EMAIL": {"mask_type": "blur"}})
    config = F.from_json(F.lit('{"EMAIL":{"mask_type":"blur"}}'), masking.MASK_CONFIG_MAP)
    with pytest.raises(Exception, match="unknown mask_type"):
        sanitizing.mask(one(spark, text="mail a@b.co"), config).select("masked_text").collect()


def test_mask_length_and_config_column(spark):
    df = spark.createDataFrame(
        [("mail a@b.co", '{"EMAIL":{"mask_type":"full","mask_char":"#","mask_length":3}}'), ("mail a@b.co", "{}")],
        "text string, cfg string",
    ).withColumn("cfg", F.from_json("cfg", masking.MASK_CONFIG_MAP))
    rows = sanitizing.mask(df, F.col("cfg")).select("masked_text").collect()
    assert [r[0] for r in rows] == ["mail ###", "mail ******"]


def test_load_policy(tmp_path):
    yaml_file = tmp_path / "p.yaml"
    yaml_file.write_text("default_policy: {action: warn, confidence_threshold: 0.1}\nentity_policies: {}\n")
    assert load_policy(str(yaml_file)).default["action"] == "warn"
    assert load_policy(str(tmp_path / "missing.yaml")).document == fallback_document()
    assert "URL" not in fallback_document()["entity_policies"] and "URL" in DEFAULT_DOCUMENT["entity_policies"]
    assert Policy().merged({"entity_policies": {"X": {"action": "block"}}}).for_entity("EMAIL")["action"] == "mask"


def test_policy_variants(spark):
    df = spark.createDataFrame([("mail a@b.co",), ("ssn 123-45-6789 mail a@b.co",), ("host 10.0.0.1",)], "text string")
    unknown = Policy().merged({"entity_policies": {"EMAIL": {"action": "ponder", "confidence_threshold": 0.5}}})
    rows = sanitizing.sanitize(df, unknown).select("action_taken", "sanitized_text").collect()
    assert rows[0]["action_taken"] == "ponder" and rows[0]["sanitized_text"] == "mail a@b.co"
    bypass = sanitizing.sanitize(df, role="admin", bypass=True).select("action_taken").collect()
    assert [r[0] for r in bypass] == ["mask", "block", "allow"]
    # A high-risk type below its threshold stays a mask when another type masks.
    strict = Policy().merged({"entity_policies": {"US_SSN": {"action": "block", "confidence_threshold": 0.95}, "EMAIL": {"action": "mask", "confidence_threshold": 0.5}}})
    row = sanitizing.sanitize(df.filter("text like 'ssn%'"), strict).first()
    assert row["action_taken"] == "mask" and row["sanitized_text"] == "ssn *********** mail ******"


def test_policy_table_round(spark):
    table = policies.policy_table(spark, Policy())
    assert policies.validate_policies(table).count() == 0
    assert table.filter("section = 'entity_policies'").count() == 11
    config = {r["entity_type"]: r["mask_type"] for r in policies.default_masking_config(table).collect()}
    assert config == {"EMAIL": "partial", "PHONE_NUMBER": "partial", "IP_ADDRESS": "full", "DEFAULT": "full"}


def test_payload_edges(spark):
    cases = [
        ("openai", '{"prompt":"mail a@b.co","n":1.5,"flag":true,"none":null,"é":"ü\\"\\n"}'),
        ("openai", '{"messages":[{"role":"user","content":"mail a@b.co"}]}'),
        ("openai", '{"input":["mail a@b.co",1,{"z":1,"a":2}],"messages":"x"}'),
        ("openai", '{"prompt":"ssn 123-45-6789"}'),
        ("anthropic", '[{"content":"mail a@b.co"},5,"mail a@b.co"]'),
        ("google", "not json"),
        ("other", '{"prompt":"ssn 123-45-6789"}'),
        ("openai", "{}"),
    ]
    df = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(cases)], "id int, service string, payload string")
    rows = {r["id"]: r for r in payload.sanitize_payload(df).collect()}
    assert json.loads(rows[0]["sanitized_payload"]) == {"prompt": "mail a***@b.co".replace("a***", "a"), "n": 1.5, "flag": True, "none": None, "é": 'ü"\n'}
    assert rows[1]["sanitized_payload"] == cases[1][1] and not rows[1]["sanitization_applied"]
    assert json.loads(rows[2]["sanitized_payload"]) == {"input": ["mail a@b.co", 1, {"z": 1, "a": 2}], "messages": "x"}
    assert rows[2]["sanitization_applied"]
    assert rows[3]["status"] == "blocked" and rows[3]["sanitized_payload"] is None
    assert [e["entity_type"] for e in rows[3]["detected_entities"]] == ["US_SSN"]
    assert json.loads(rows[4]["sanitized_payload"]) == [{"content": "mail a@b.co"}, 5, "mail a@b.co"]
    assert (rows[5]["status"], rows[5]["sanitized_payload"]) == ("invalid", None) and rows[6]["sanitized_payload"] == cases[6][1]
    assert rows[7]["sanitized_payload"] == "{}"
    longer = spark.createDataFrame([("openai", '{"z":1,"prompt":"mail jane@b.co","input":["mail jane@b.co","k"]}')], "service string, payload string")
    assert payload.sanitize_payload(longer).first()["sanitized_payload"] == '{"z":1,"prompt":"mail j***@b.co","input":["mail j***@b.co","k"]}'
    reply = spark.createDataFrame([("anthropic", '{"content":"ssn 123-45-6789"}')], "service string, payload string")
    assert payload.sanitize_response(reply).first()["sanitized_payload"] == '{"content":"ssn ***********"}'


def test_outbound(spark):
    df = spark.createDataFrame([("mail a@b.co", "clear"), ("ssn 123-45-6789", "clear"), ("  ", "clear"), ("x" * 10001, "clear"), ("hi", "rude")], "text string, tone string")
    rows = sanitizing.prepare_outbound(df, tone=F.col("tone")).select("status", "sent_text").collect()
    assert [tuple(r) for r in rows] == [
        ("ok", "mail [REDACTED_EMAIL]"), ("blocked", None), ("invalid_length", None), ("invalid_length", None), ("unsupported_tone", None),
    ]


def test_external_spans_come_first(spark):
    texts = spark.createDataFrame([(1, "mail a@b.co"), (2, "nothing")], "doc_id int, text string")
    found = spark.createDataFrame([(1, "EMAIL_ADDRESS", 5, 11, 0.9)], "doc_id int, entity_type string, start int, end int, confidence double")
    joined = external.external_spans(texts, found, "doc_id")
    rows = {r["doc_id"]: r for r in detect(joined, external_col="external_spans").collect()}
    assert [(e["entity_type"], e["text"]) for e in rows[1]["entities"]] == [("EMAIL", "a@b.co")]
    assert rows[1]["detection_metadata"]["external_entities"] == 1 and rows[2]["entities"] == []


def test_access(spark):
    roles = access.default_roles(spark).withColumn("is_active", F.col("role") != "analyst")
    users = spark.createDataFrame(
        [("u1", "a", "e", ["user"], [], True), ("u2", "b", "e", ["analyst"], ["export_data"], True), ("u3", "c", "e", ["admin"], [], False), ("u4", "d", "e", ["guest"], ["api_admin"], True), ("u5", "f", "e", ["security_officer"], [], True)],
        "user_id string, username string, email string, roles array<string>, permissions array<string>, is_active boolean",
    )
    total = {r["user_id"]: set(r["total_permissions"]) for r in access.with_permissions(users, roles).collect()}
    assert total["u1"] == set(access.ROLE_PERMISSIONS["user"])
    assert total["u2"] == {"export_data"}  # inactive role
    assert total["u3"] == set()
    assert total["u5"] == set(access.ROLE_PERMISSIONS["security_officer"])
    requests = spark.createDataFrame(
        [(1, "u1", "detect_pii", "report", "x"), (2, "u1", "export_data", "user", "u1"), (3, "u1", "export_data", "user", "u2"), (4, "u3", "detect_pii", "report", "x"), (5, "nobody", "detect_pii", "report", "x"), (6, "u4", "manage_users", "report", "x")],
        "request_id int, user_id string, permission string, resource_type string, resource_id string",
    )
    reasons = {r["request_id"]: r["reason"] for r in access.authorize(requests, users, roles).collect()}
    assert reasons == {1: "permission", 2: "own_resource", 3: "denied", 4: "user_inactive", 5: "user_not_found", 6: "admin_override"}


def test_encryption(spark):
    df = detect(one(spark, text="mail a@b.co"))
    key = F.lit("0123456789abcdef")
    hidden = protect.encrypt_findings(df, key).cache()
    row = hidden.first()
    assert row["text"] != "mail a@b.co" and row["entities"][0]["text"] != "a@b.co"
    assert row["entities"][0]["entity_type"] == "EMAIL" and row["risk_score"] == df.first()["risk_score"]
    assert protect.decrypt_findings(hidden, key).drop("detection_metadata").first() == df.drop("detection_metadata").first()
    with pytest.raises(ValueError):
        protect.encrypt_findings(df.withColumnRenamed("entities", "found"), key)


@pytest.mark.parametrize("body", ['{"prompt":"ssn 123-45-6789","prompt":"x"}', '{"prompt":"ssn 123-45-6789"', "ssn 123-45-6789", None])
def test_bodies_that_do_not_parse_stay_inside(spark, body):
    df = spark.createDataFrame([("openai", body)], "service string, payload string")
    for found in (payload.sanitize_payload(df), payload.sanitize_response(df)):
        row = found.first()
        assert (row["status"], row["sanitized_payload"]) == ("invalid", None)


def test_nested_maps_are_redacted(spark):
    kind = "m map<string,int>, n map<string,array<string>>, p map<string,map<string,string>>, q array<struct<token:int,t:string>>"
    row = ({"password": 123, "x": 1}, {"k": ["a@b.co"], "email": ["z"]}, {"o": {"secret": "s", "t": "call 555-123-4567"}}, [(5, "a@b.co")])
    got = redaction.redact_fields(spark.createDataFrame([row], kind)).first()
    assert got["m"] == {"password": None, "x": 1} and got["n"] == {"k": ["[EMAIL]"], "email": None}
    assert got["p"] == {"o": {"secret": "[REDACTED]", "t": "call [PHONE]"}}
    assert [tuple(x) for x in got["q"]] == [("[REDACTED]", "[EMAIL]")]


def test_detect_distinct_equals_detect(spark):
    df = spark.createDataFrame([(1, None), (2, "mail a@b.co"), (3, None), (4, "mail a@b.co"), (5, "")], "id int, text string")
    columns = ["id", "entities", "risk_score", "has_high_risk_pii", "detection_metadata"]
    want = sorted(map(str, detect(df).select(columns).collect()))
    assert sorted(map(str, batch.detect_distinct(df, ["id"]).select(columns).collect())) == want


def test_reports_are_whole_unless_asked(spark):
    rows = [(f"e{i}", "sanitization", datetime(2024, 1, 2), date(2024, 1, 2), "block", "r", "user", 0.5, i) for i in range(1200)]
    schema = "event_id string, event_type string, timestamp timestamp, event_date date, action_taken string, blocked_reason string, user_role string, risk_score double, entities_detected int"
    df = spark.createDataFrame(rows, schema)
    span = (datetime(2024, 1, 1), datetime(2024, 1, 3))
    assert audit.blocked_report(df, *span).count() == 1200 and audit.blocked_report(df, *span, size=7).count() == 7
    found = df.withColumn("event_type", F.lit("detection"))
    assert audit.detection_report(found, *span).count() == 1203 and audit.detection_report(found, *span, size=10).count() == 13


def test_log_redaction(spark):
    texts = ["user@x.io 555-123-4567 5551234567 123-45-6789 4532-1234-5678-9012", "(555) 123-4567", "٣٣٣-٤٤-٥٥٥٥", "é123-45-6789", "1234 5678 9012 3456", "4532123456789012"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", redaction.redact_string(F.col("t")).alias("o")).collect():
        want = r["t"]
        for pattern, label in redaction.LOG_PATTERNS:
            want = re.sub(pattern, label, want)
        assert r["o"] == want


def test_calibration_training(spark):
    schema = "features struct<" + ",".join(f"{n}:double" for n in cal.FEATURE_WEIGHTS) + ">, label double"
    rows = [((0.9, 0.5, 1.0, 1.0, 1.0), 1.0) if i % 2 else ((0.7, 0.0, 1.0, 1.0, 0.5), 0.0) for i in range(15)]
    row = semantic.train_calibrator(spark.createDataFrame(rows, schema)).first()
    raw = {"pattern_match_score": 0.3 * 1.02, "context_score": 0.25 * 1.05, "position_score": 0.15, "length_score": 0.1, "surrounding_text_score": 0.2 * 1.05}
    assert row["is_trained"] and row["samples"] == 15
    for name, value in raw.items():
        assert row[name] == pytest.approx(value / sum(raw.values()))
    few = semantic.train_calibrator(spark.createDataFrame(rows[:5], schema)).first()
    assert not few["is_trained"] and few["context_score"] == 0.25
    single = semantic.train_calibrator(spark.createDataFrame([r for r in rows * 3 if r[1] == 1.0], schema)).first()
    assert single["is_trained"] and single["context_score"] == 0.25


def test_position_and_length_scores(spark):
    df = spark.createDataFrame([(5, 2), (50, 16), (105, 60)], "start int, n int")
    span = F.struct("start", F.repeat(F.lit("x"), F.col("n")).alias("text"), F.lit("an example TEST of it").alias("context"), F.lit(0.9).alias("confidence"))
    rows = df.select(cal.calibration_features(span, F.lit(110)).alias("f")).collect()
    assert [(r["f"]["position_score"], r["f"]["length_score"], r["f"]["surrounding_text_score"]) for r in rows] == [(0.8, 0.3, 0.6), (1.0, 1.0, 0.6), (0.6, 0.7, 0.6)]


def test_read_and_write_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail jane@b.co\nline two")
    (tmp_path / "in" / "b.txt").write_text("nothing")
    texts = text_io.read_texts(spark, str(tmp_path / "in"))
    assert sorted(r["text"] for r in texts.collect()) == ["mail jane@b.co\nline two", "nothing"]
    masked = sanitizing.mask_uniform(texts)
    text_io.write_findings(masked, str(tmp_path / "findings"))
    assert spark.read.json(str(tmp_path / "findings")).select("type", "matched_text").collect() == [("EMAIL", "jane@b.co")]
    text_io.write_masked(masked, str(tmp_path / "masked"))
    back = spark.read.parquet(str(tmp_path / "masked"))
    assert "text" not in back.columns and "entities" not in back.columns
    assert sorted(r["masked_text"] for r in back.collect()) == ["mail j***@b.co\nline two", "nothing"]


def test_plans_of_row_local_operators_do_not_shuffle(spark):
    df = corpora.table(spark, SF, "documents")
    bodies = df.select("doc_id", F.lit("openai").alias("service"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("payload"))
    for plan in (
        sanitizing.mask_uniform(df).select("doc_id", "masked_text"),
        sanitizing.prepare_outbound(df).select("doc_id", "sent_text"),
        payload.sanitize_payload(bodies).select("doc_id", "sanitized_payload"),
        redaction.redact_fields(df),
        df.select(spans.sentence_split(F.col("text"))),
    ):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Python" not in text


def test_filters_reach_the_scan_and_detection_runs_once(spark):
    df = corpora.table(spark, SF, "documents")
    plan = detect(df).filter("lang = 'en' and has_high_risk_pii").select("doc_id", "risk_score")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text
    assert text.count("AKIA[0-9A-Z]") == 1
