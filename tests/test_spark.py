"""Catalyst expressions against the kernel, and the operators on DataFrames."""

import json

import pytest
from pyspark.sql import functions as F

from cloakframe import kernel as K
from cloakframe.functions import arrow, native
from cloakframe.operators import audit, chat, detection, guard
from cloakframe.policy import Policy
from cloakframe.sources import readers
from cloakframe.streaming import streams

TEXTS = [
    None,
    "",
    "Mail a.b@c.org, a..b@c.org and x@y",
    "é123-45-6789é 123-45-6789 000-12-3456 SSN 987654320",
    "4111 1111 1111 1111 then 5500000000000004 and 4111111111111112 x4222222222222",
    "1.2.3.4 256.1.1.1 01.2.3.4 10.0.0.255.",
    "DE89370400440532013000 and DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819",
    "AB1234567 K98765432 123456789A XAB1234567Y",
    "1234 5678 9012 ABCDE1234F 123 456 789 1850377123456",
    "+1 (202) 555-0123, 030 12345678\n1111111111 (202) 555-0124x",
    "漢字 john@example.com 😀 +442079460958 お",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("pii_type", native.NATIVE)
@pytest.mark.parametrize("strict", [True, False])
def test_native_equals_kernel(texts, pii_type, strict):
    (det,) = K.built_in([pii_type])
    got = texts.select("id", native.detect(F.col("text"), pii_type, strict).alias("d")).collect()
    for r in got:
        assert [tuple(x) for x in r.d] == [tuple(f) for f in K.detect_one(det, TEXTS[r.id], strict)]


def test_native_equals_kernel_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    dets = K.built_in(native.NATIVE)
    for r in docs.select("text", native.detect_all(F.col("text")).alias("d"), native.redact(Policy(), F.col("text"), native.detect_all(F.col("text"))).alias("m")).collect():
        assert [tuple(x) for x in r.d] == [tuple(f) for f in K.detect(dets, r.text, anchored=False)]
        assert r.m == K.redact(dets, Policy(), r.text, anchored=False).text


@pytest.mark.parametrize("policy", [Policy(), Policy().with_mode("replace"), Policy().with_mode("tokenize"), Policy().with_blocklist(["and", "SSN"]).with_allowlist(["john@example.com", "SSN"]), Policy().with_placeholder("email", "<m>").disable("ssn")])
def test_native_redaction_equals_kernel(texts, policy):
    dets = K.built_in(native.NATIVE)
    for r in texts.select("id", native.redact(policy, F.col("text"), native.detect_all(F.col("text"))).alias("m")).collect():
        t = TEXTS[r.id]
        assert r.m == (None if t is None else K.redact(dets, policy, t, anchored=False).text)


def test_native_plan_has_no_python(texts):
    plan = detection.with_detections(texts, types=["email", "ssn"], anchored=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_arrow_redaction(texts):
    for r in detection.redacted(texts).select("id", "text", "redacted").collect():
        want = K.redact(K.built_in(), Policy(), r.text)
        assert r.redacted.text == (None if r.text is None else want.text) and r.redacted.changed == want.changed


JSONS = [
    ('{"count": 42, "price": 19.99, "active": true, "data": null, "sci": 1e10}', {"count": 42, "price": 19.99, "active": True, "data": None, "sci": 1e10}),
    ('{"ssn": "123-45-6789"}', {"ssn": "███-██-████"}),
    ('{"emails": ["a@co.com", "b@co.com"], "n": {"m": ["x@y.com"]}}', {"emails": ["█@██.com", "█@██.com"], "n": {"m": ["█@█.com"]}}),
    ("{}", {}),
    ("[]", []),
    ('[1, "text", true, null, 2.71, {"key": "value"}]', [1, "text", True, None, 2.71, {"key": "value"}]),
]


def test_json(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(JSONS)] + [(90, '{"broken": '), (91, None)], "id int, doc string")
    got = {r.id: r for r in df.select("id", arrow.redact_json(F.col("doc")).alias("a"), arrow.redact_json(F.col("doc"), pretty=True).alias("p")).collect()}
    for i, (_, want) in enumerate(JSONS):
        assert json.loads(got[i].a.json) == want and json.loads(got[i].p.json) == want and got[i].a.error is None
    assert "1e10" in got[0].a.json and "\n  " in got[0].p.json
    assert got[90].a.json is None and got[90].a.error
    assert got[91].a is None


def test_strip_internal(spark):
    df = spark.createDataFrame([('{"b":1,"provider":"x","_internal_id":2}',), ('"bare"',), ("broken",)], "doc string")
    assert [r[0] for r in df.select(arrow.strip_internal_fields(F.col("doc"))).collect()] == ['{"b":1}', '"bare"', "broken"]


def test_chat_round_trip(spark):
    rows = [(1, "m", None, None, None, None, [("system", "be kind"), ("user", "Contact me at john@example.com")])]
    df = spark.createDataFrame(rows, "id int, model string, max_tokens int, temperature double, top_p double, stream boolean, messages array<struct<role:string,content:string>>")
    tok = chat.tokenise(df).first()
    assert tok.messages[1].content == "[[PII_0]]" and tok.tokens == {"[[PII_0]]": "Contact me at john@example.com"}
    noted = chat.with_note(chat.tokenise(df)).first()
    assert noted.messages[0].role == "system" and "[[PII_0]] = redacted value (C***m)" in noted.messages[0].content
    done = chat.complete(df, chat.echo).first()
    assert done.status == 200 and done.reply.choices[0].message.content == "Contact me at john@example.com"
    assert json.loads(chat.translate_request("anthropic", df).first().body) == {"model": "m", "max_tokens": 4096, "system": "be kind", "messages": [{"role": "user", "content": "Contact me at john@example.com"}]}
    assert json.loads(chat.translate_request("gemini", df).first().body)["systemInstruction"] == {"parts": [{"text": "be kind"}]}


def test_reports_and_sql(spark, texts):
    detection.register_sql(spark)
    assert spark.sql("select redact_pii('SSN: 123-45-6789') as r").first().r == "SSN: ███-██-████"
    assert spark.sql("select redact_pii_json('{\"a\":\"123-45-6789\"}') as r").first().r == '{"a":"███-██-████"}'
    assert spark.sql("select pii_type from detected_pii('x -123-45-6789')").first().pii_type == "ssn"
    assert spark.sql("select size(detect_pii('x -123-45-6789')) as n").first().n == 1
    row = texts.where("id = 2").withColumn("d", native.detect(F.col("text"), "email")).select(readers.validate_text(F.col("d")).alias("t"), readers.validate_report(F.col("text"), F.col("d"), F.col("text")).alias("j")).first()
    assert row.t.startswith("Found 1 PII detection(s):") and json.loads(row.j)["has_pii"] is True


def test_audit(spark):
    df = spark.createDataFrame([(1, "Contact me by john@example.com")], "id int, text string").withColumn("detections", native.detect(F.col("text"), "email"))
    e = audit.detection_events(df, "id").first()
    assert (e.pii_type, e.confidence, e.original_len) == ("email", "medium", 16)
    line = audit.as_json(audit.custom_event(df, "config", "loaded")).first().value
    assert json.loads(line)["category"] == "config"
    assert audit.exposition(spark.createDataFrame([("email", 2)], "t string, n long"), "pii_total", "t").first().value == 'pii_total{t="email"} 2'


def test_guards(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0, i) for i in range(6)] + [("b", t0, 9), ("a", t0 + dt.timedelta(seconds=1), 10)]
    df = spark.createDataFrame(rows, "ip string, ts timestamp, k int")
    got = {(r.ip, r.k): r.allowed for r in guard.rate_limited(df, 1, 5, order="k").collect()}
    assert [got["a", i] for i in range(6)] == [True] * 5 + [False] and got["b", 9] and got["a", 10]
    with pytest.raises(ValueError):
        guard.resolve_keys([{"env": "NO_SUCH_VARIABLE_HERE"}])
    assert guard.resolve_keys([{"value": "k"}]) == ["k"]


CHUNKS = [
    ("a", ["hello ", "world"]),
    ("b", ["Email: ", "test@example.com ", "for info"]),
    ("c", ["SSN: 123-", "45-6789"]),
    ("d", list("Contact john@example.com now")),
    ("e", ["line1\n", "line2 with test@example.com\n", "line3\n"]),
]


def chunk_rows():
    for sid, chunks in CHUNKS:
        for i, c in enumerate(chunks):
            yield sid, i, c, i + 1 == len(chunks), None
    yield "f", 0, "hello wor", False, None
    yield "f", 1, None, False, "reset"


SCHEMA = "stream_id string, seq long, chunk string, is_end boolean, error string"


def check_chunks(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r.stream_id, r.seq)):
        by.setdefault(r.stream_id, []).append(r.chunk if r.error is None else f"!{r.error}")
    assert by["a"] == ["hello ", "world"] and by["f"] == ["hello ", "!reset"]
    assert "".join(by["c"]) == "SSN: ███-██-████"
    for k in "bde":
        assert "@example.com" not in "".join(by[k]).replace("@███████.com", "")


def test_chunks(spark):
    check_chunks(streams.redact_chunks(spark.createDataFrame(list(chunk_rows()), SCHEMA)).collect())


def test_chunk_stream(spark, tmp_path):
    rows = list(chunk_rows())
    spark.createDataFrame(rows[:6], SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    spark.createDataFrame(rows[6:], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.redact_stream(source).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    check_chunks(spark.table("chunks").collect())


def test_state_of_a_stream_without_an_end_expires(spark, tmp_path):
    import time

    src = tmp_path / "in"
    src.mkdir()
    row = {"stream_id": "s", "is_end": False, "error": None}
    schema = "stream_id string, seq long, chunk string, is_end boolean, error string"
    out = str(tmp_path / "out")

    def run():
        source = spark.readStream.schema(schema).json(str(src))
        q = streams.redact_stream(source, ttl_seconds=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        until = time.time() + 60
        while time.time() < until and not any(p["numInputRows"] for p in q.recentProgress):
            time.sleep(0.2)
        q.stop()

    (src / "a.json").write_text(json.dumps(row | {"seq": 0, "chunk": "left behind"}))
    run()
    time.sleep(2)
    (src / "b.json").write_text(json.dumps(row | {"seq": 1, "chunk": "new ", "is_end": True}))
    run()
    got = spark.read.schema("stream_id string, seq long, chunk string, error string").parquet(out).orderBy("seq").collect()
    assert [r.chunk for r in got] == ["left ", "new "]


def test_detections_are_computed_once(spark):
    from cloakframe.plans import catalogue

    d = "/root/testdata/sf0.001"
    for name, times in (("q_resolve_overlaps", 3), ("q_email_spans", 1), ("q_metrics_rollup", 2)):
        plan = catalogue.queries()[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == times, name
    plan = catalogue.queries()["q_anchored_detect"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_cards_far_from_blanks_are_redacted_as_in_sql(spark, tmp_path):
    import duckdb

    from cloakframe.plans import catalogue

    texts = ["4328325728555127", "4328325728555128", "The\n4328325728555127.\n" + "x" * 70 + " y 1.2.3.4", "é\n4328325728555127\na.b@c.org\n1.2.3.4\n+1 (839) 555-3421", "+1 (867) 555-1974 4203211868239051 reo st", "", None]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").coalesce(1).write.parquet(at)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.queries()["q_redact_all_types"](spark, str(tmp_path)).select("doc_id", "redacted").collect())
    assert got == sorted(con.sql(catalogue.oracle_sql()["q_redact_all_types"]).project("doc_id, redacted").fetchall())
    assert got[0][1] == "████████████5127"


def test_providers_are_built_from_configuration(monkeypatch):
    monkeypatch.setenv("SOME_KEY", "from-env")
    keys, warnings = chat.build_providers({"openai": {"value": "k"}, "google": {"env": "SOME_KEY"}, "cohere": {"env": "NOT_SET"}, "nobody": {"value": "x"}})
    assert keys == {"openai": "k", "google": "from-env"} and len(warnings) == 2
    assert "cohere" in warnings[0] and "nobody" in warnings[1] and chat.build_providers({}) == ({}, [])


def test_exchange(spark):
    rows = [(1, None, "mail a@b.org"), (2, "GOOGLE", "mail c@d.org"), (3, "cohere", "x"), (4, "openai", None), (5, "google", "fails"), (6, "openai", "odd")]
    df = spark.createDataFrame([(i, p, [("system", "be kind"), ("user", t)]) for i, p, t in rows], "id int, provider string, messages array<struct<role:string,content:string>>")
    df = df.selectExpr("*", "'m' as model", "10 as max_tokens", "0.5D as temperature", "cast(null as double) as top_p", "false as stream")

    def respond(provider, body):
        gemini = F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), F.to_json(F.array(F.get_json_object(body, "$.contents[0].parts[0].text"))).substr(2, 1000), F.lit("}]}}]}"))
        gemini = F.replace(gemini, F.lit(']}]}}]}'), F.lit('}]}}]}'))
        return F.when(F.col("id") == 5, F.lit(None)).when(F.col("id") == 6, "not json").when(provider == "google", gemini).otherwise(chat.echo(body))

    got = {r.id: r for r in chat.exchange(df, respond, ["openai", "google"]).collect()}
    assert [got[i].status for i in range(1, 7)] == [200, 200, 404, 200, 502, 502]
    assert [got[i].error_kind for i in range(1, 7)] == [None, None, None, None, "request_error", "parse_error"]
    assert got[1].reply.choices[0].message.content == "mail a@b.org" and got[2].reply.choices[0].message.content == "mail c@d.org"
    assert "a@b.org" not in got[1].body and "[[PII_0]]" in got[2].body and got[3].body is None and got[3].error == "Unknown provider: cohere"
    counts = {(r.metric, r.provider, r.error): r.n for r in audit.provider_counters(chat.exchange(df, respond, ["openai", "google"])).collect()}
    assert counts == {("requests", "openai", None): 3, ("requests", "google", None): 2, ("errors", "google", "request_error"): 1, ("errors", "openai", "parse_error"): 1}
