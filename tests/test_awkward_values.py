"""Escaped names, malformed texts, odd numbers, times and blanks."""

import datetime
import json
import math

from pyspark.sql import functions as F

from mnemoscope.functions.number import _wide_within, within
from mnemoscope.functions.redact import redact_json
from mnemoscope.functions.text import blank, zoned_timestamp
from mnemoscope.functions.tokens import wire_parts
from mnemoscope.operators import fixtures as X
from mnemoscope.operators import metrics as M
from mnemoscope.plans.jobs import score_runs


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")


def test_escaped_secrets_are_masked(spark):
    texts = [r'{"password":"s3cret"}', r'{"a":"Bearer abc"}', '{"a":[["token","x"],{"b":{"API-key":1}}]}', "not json, api token", '{"a":1}', None,
             "[" * 3000 + '"Bearer x"' + "]" * 3000, r'{"a":"six\/long"}']
    got = [r.x for r in column(spark, texts).select(redact_json(F.col("v"), ("six/long",)).alias("x")).collect()]
    assert json.loads(got[0]) == {"password": "[REDACTED]"} and json.loads(got[1]) == {"a": "Bearer [REDACTED]"}
    assert json.loads(got[2]) == {"a": [["token", "[REDACTED]"], {"b": {"API-key": "[REDACTED]"}}]}
    assert got[3] is None and got[4] == '{"a":1}' and got[5] is None and json.loads(got[7]) == {"a": "[REDACTED]"}
    assert got[6] is None or "Bearer [REDACTED]" in got[6]


def test_leaks_of_escaped_repeated_and_deep_names(spark):
    deep = '{"a":' * 400 + '{"facts":1}' + "}" * 400
    texts = [r'{"facts":[]}', '{"facts":1,"facts":2}', deep, '{"facts": broken', '{"note":"facts"}']
    rows = column(spark, texts)
    got = sorted((r.id, r.path) for r in X.gold_leaks(rows, "id", "v").collect())
    assert got == [(0, "$.facts"), (1, "$.facts"), (1, "$.facts"), (2, "$" + ".a" * 400 + ".facts"), (3, "$")]
    assert {r.id for r in X.leaking_rows(rows, "id", "v").collect()} == {0, 1, 2, 3}


def test_many_payloads_have_no_row_limit(spark):
    rows = spark.range(300_000).select("id", F.concat(F.lit('{"a":[1,2,{"b":'), "id", F.lit(',"matchType":"x"}]}')).alias("v"))
    assert X.gold_leaks(rows, "id", "v").count() == 300_000


def test_iso_forms_with_a_zone(spark):
    texts = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.123456789Z", "2026-01-02 03Z", "2026-01-02T03:04+02", "20260102T030405-0130", "2026-01-02T03:04:05.5+00:00",
             "2026-01-02T03:04:05", "2026-13-02T03:04:05Z", "yesterday", None]
    got = [r.t for r in column(spark, texts).orderBy("id").select(zoned_timestamp(F.col("v")).alias("t")).collect()]
    for text, value in zip(texts, got):
        try:
            want = datetime.datetime.fromisoformat(text)
        except (TypeError, ValueError):
            want = None
        if want is None or want.tzinfo is None:
            assert value is None, text
        else:
            assert value.astimezone(datetime.timezone.utc) == want, text


def test_unicode_blanks(spark):
    texts = ["", " ", " ", "　 \x1c\x85\t", "a", " a", None, "​"]
    got = [r.b for r in column(spark, texts).orderBy("id").select(blank(F.col("v")).alias("b")).collect()]
    assert got == [t is None or not t.strip() for t in texts]


def test_wide_numbers_compare_exactly(spark):
    cases = [("1e999999999", "1e999999999", "0", True), ("1e999999999", "1", "1e999999998", False), ("1e40", "10000000000000000000000000000000000000001", "1", True),
             ("1e-999999999", "0", "1e-999999999", True), ("1e-999999999", "0", "0", False), ("0.1" + "0" * 40 + "1", "0.1", "1e-42", True), ("-5e30", "5e30", "1e31", True),
             ("-5e30", "5e30", "9.99e30", False), ("0e5", "0", "0", True)]
    for a, b, limit, want in cases:
        assert _wide_within(a, b, limit) is want, (a, b, limit)
    frame = spark.createDataFrame([c[:3] for c in cases], "a string, b string, l string")
    assert [r.x for r in frame.select(within(F.col("a"), F.col("b"), F.col("l")).alias("x")).collect()] == [c[3] for c in cases]


def test_impossible_latencies_do_not_count(spark):
    values = [1.0, 2.0, math.nan, math.inf, -1.0, None]
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "runId string, n int, latencyMs double")
    got = M.latency(rows).first()
    assert (got["count"], got["mean"], got.p50, got.p95, got.min, got.max) == (2, 1.5, 1.0, 2.0, 1.0, 2.0)
    assert {r.n for r in M.latency_violations(rows, ["n"]).collect()} == {2, 3, 4}


def test_requests_without_their_parts_give_nulls(spark):
    rows = column(spark, ['{"messages":[]}', "broken", "[1]", "null", None])
    assert all(r.p.body is None for r in rows.select(wire_parts(F.col("v")).alias("p")).collect())
