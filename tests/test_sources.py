import hashlib
import json

from pyspark.sql import functions as F

from mnemoscope import schemas
from mnemoscope.functions import canonical
from mnemoscope.functions.redact import longest_first, redact_json, redact_text
from mnemoscope.functions.tokens import count_tokens, over_budget, register_tokenizer, wire_parts
from mnemoscope.operators import archive as A
from mnemoscope.operators import fixtures as X
from mnemoscope.quality import archive_rules as R
from mnemoscope.sources import calibration_json, jsonl, provider_log, publish

import pytest
from builders import by_scope, native_request


def test_jsonl_keeps_missing_apart_from_empty_and_rejects_the_rest(spark, tmp_path):
    lines = ['{"runId":"r","tierSegments":[{"tier":"stable"},{"tier":"unstable","sourceIds":[]}]}', "[1]", '{"a":1,"a":2}', "{", '{"latencyMs":NaN}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    rows, rejects = jsonl.read_jsonl(spark, str(tmp_path), schemas.REQUEST)
    segments = rows.first().tierSegments
    assert segments[0].sourceIds is None and segments[1].sourceIds == [] and rows.count() == 1
    assert rejects.count() == 4


def test_appended_logs_are_redacted(spark, tmp_path):
    rows = spark.createDataFrame([("r", "Bearer abc", "x")], "runId string, message string, api_key string")
    jsonl.append_jsonl(rows, str(tmp_path / "log"))
    line = spark.read.text(str(tmp_path / "log")).first().value
    assert json.loads(line) == {"runId": "r", "message": "Bearer [REDACTED]", "api_key": "[REDACTED]"}


def test_redaction_by_name_pair_pattern_and_secret(spark):
    value = {"headers": {"Authorization": "Basic one", "X-API-Key": "two"}, "pairs": [["Proxy-Authorization", "Digest three"]],
             "error": 'denied; Authorization: Basic four; api_key="five"; requestId=r-17', "literal": "keep six-long and six", "requestId": "r-17"}
    clean = {"requestId": "r-18", "tokens": 4}
    rows = spark.createDataFrame([(json.dumps(value),), (json.dumps(clean),)], "t string")
    masked, same = [json.loads(r.x) for r in rows.select(redact_json(F.col("t"), ("six", "six-long")).alias("x")).collect()]
    assert not any(word in json.dumps(masked) for word in ("one", "two", "three", "four", "five", "six"))
    assert masked["requestId"] == "r-17" and "requestId=r-17" in masked["error"] and "denied" in masked["error"]
    assert same == clean and longest_first(["a", "bb", "a"]) == ["bb", "a"]
    text = spark.createDataFrame([("proxy-authorization: x y, next; Bearer tok.en api key = 'q r' end",)], "t string").select(redact_text(F.col("t")).alias("x")).first().x
    assert text == "proxy-authorization: [REDACTED], next; Bearer [REDACTED] api key = [REDACTED] end"


def test_canonical_hashes(spark):
    value = {"b": [1, "é", None], "a": {"y": True, "x": 0.5}}
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
    row = spark.createDataFrame([(json.dumps(value),)], "t string").select(
        canonical.canonical_json(F.col("t")).alias("c"), canonical.digest(F.col("t")).alias("d"), canonical.archived_digest(F.col("t")).alias("a")).first()
    assert row.c == text and row.d == row.a == hashlib.sha256(text.encode()).hexdigest()
    floats = spark.createDataFrame([('{"x":1.0,"y":1e22}',)], "t string").select(canonical.archived_digest(F.col("t")).alias("a")).first()
    assert floats.a == hashlib.sha256(b'{"x":1.0,"y":1e+22}\n').hexdigest()


@pytest.mark.parametrize("size, rejected", [(25_000, False), (25_001, True)])
def test_budget_boundary_over_the_wire(spark, size, rejected):
    request = native_request()
    base = len(wire(request))
    request["messages"][1]["content"] = "x" * (size - base + len(json.dumps(request["messages"][1]["content"], separators=(",", ":"))) - 2)
    row = spark.createDataFrame([(json.dumps(request),)], "t string").withColumn("w", wire_parts(F.col("t"))).select(
        F.col("w.body").alias("body"), over_budget(count_tokens(F.col("w.body"))).alias("over")).first()
    assert row.body == wire(request) and len(row.body) == size and row.over is rejected


def wire(request):
    def call(c):
        return {"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": json.dumps(c["arguments"], separators=(",", ":"))}}
    messages = []
    for m in request["messages"]:
        w = {"role": m["role"], "content": m["content"]}
        if "toolCalls" in m:
            w["tool_calls"] = [call(c) for c in m["toolCalls"]]
        if "toolCallId" in m:
            w["tool_call_id"] = m["toolCallId"]
        messages.append(w)
    body = {"model": "v1", "messages": messages, "temperature": 0, "seed": 5, "tools": [{"type": "function", "function": t} for t in request["tools"]]}
    return json.dumps(body, separators=(",", ":"), ensure_ascii=False)


def test_tokenizers_are_pluggable(spark):
    register_tokenizer("words", lambda text: F.size(F.split(text, " ")).cast("bigint"))
    row = spark.createDataFrame([("a b c",)], "t string").select(count_tokens(F.col("t"), "words").alias("w"), count_tokens(F.col("t")).alias("c")).first()
    assert (row.w, row.c) == (3, 5)
    with pytest.raises(ValueError):
        count_tokens(F.col("t"), "unheard-of")


def test_provider_tool_calls_are_decoded(spark):
    def body(arguments, kind="function"):
        return json.dumps({"model": "v", "choices": [{"finish_reason": "tool_calls", "message": {"content": None, "tool_calls": [
            {"id": "c", "type": kind, "function": {"name": "f", "arguments": arguments}}]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}})
    rows = spark.createDataFrame([(1, body('{"a":[1]}')), (2, body('{"a":')), (3, body('{}', "other")), (4, "nope"), (5, "{}")], "id int, body string")
    good, rejects = provider_log.native_responses(rows, "id")
    row = good.first()
    assert good.count() == 1 and json.loads(str(row.toolCalls.toJson())) == [{"id": "c", "name": "f", "arguments": {"a": [1]}}]
    assert {r.id for r in rejects.collect()} == {2, 3, 4, 5}


def test_published_identities_are_never_replaced(spark, tmp_path):
    target = str(tmp_path / "scores")
    first = spark.createDataFrame([("a", 1), ("a", 2)], "identity string, v int")
    publish.publish(first, target)
    publish.publish(spark.createDataFrame([("a", 9), ("b", 3)], "identity string, v int"), target)
    assert sorted((r.identity, r.v) for r in spark.read.parquet(target).collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_bundles_are_verified_against_their_manifest(spark, tmp_path):
    def bundle(data, declared=None, name=None, size=None):
        files = {"report.json": data}
        manifest = json.dumps({"v": data}).encode()
        digest = hashlib.sha256(manifest).hexdigest()
        folder = tmp_path / (name or digest)
        folder.mkdir()
        (folder / "manifest.json").write_bytes(manifest)
        for file, text in files.items():
            (folder / file).write_text(text)
        hashes = declared or {f: hashlib.sha256(t.encode()).hexdigest() for f, t in files.items()}
        return (folder.name, digest, hashes, size or len(manifest) + len(data))
    rows = [bundle("fine"), bundle("changed", {"report.json": "0" * 64}), bundle("moved", name="elsewhere"), bundle("large", size=5),
            bundle("short", {"report.json": hashlib.sha256(b"short").hexdigest(), "lost.json": "0" * 64})]
    manifests = spark.createDataFrame(rows, "bundle string, manifestHash string, artifactHashes map<string,string>, artifactSizeBytes bigint")
    files = publish.bundle_files(spark, str(tmp_path))
    problems = {(r.bundle, r["name"], r.problem) for r in publish.verify_bundles(files, manifests).collect()}
    assert problems == {(rows[1][0], "report.json", "hash differs"), ("elsewhere", "manifest.json", "bundle is not named after its manifest"),
                        (rows[3][0], "*", "total size differs"), (rows[4][0], "lost.json", "missing")}
    assert publish.footprint(files).filter("size(warnings) > 0").isEmpty() and publish.file_set_hash(files).count() == 5


def test_calibration_corpora_on_disk(spark, tmp_path):
    def save(folder, name, value):
        text = json.dumps(value)
        (tmp_path / folder / name).write_text(text)
        return hashlib.sha256(text.encode()).hexdigest()
    kinds = ("semantic",) * 4 + ("exact",) * 2 + ("numeric",) * 2 + ("ordered-list", "abstain")
    abilities = ("information-extraction", "cross-session-reasoning", "temporal-reasoning", "knowledge-update", "abstention")

    def row(i):
        kind = kinds[i % 10]
        expected = {"matchType": kind, "acceptedAnswers": ["blue"], "requiredFactIds": ["f"], "forbiddenFactIds": []}
        expected.update({"semantic": {"rubric": "r", "requiredClaims": ["c"], "disallowedContradictions": []},
                         "numeric": {"acceptedAnswers": ["10"], "targetNumber": "10", "tolerance": "0.5", "toleranceMode": "absolute-inclusive"},
                         "ordered-list": {"items": ["blue", "green"], "acceptedAnswers": ['["blue", "green"]']},
                         "abstain": {"acceptedAnswers": ["I do not know."], "requiredFactIds": []}}.get(kind, {}))
        return {"probeId": f"p{i}", "ability": abilities[i // 20], "question": "Which?", "candidateAnswer": "blue", "expected": expected, "goldJudgment": "pass",
                "justification": "said", "answerability": kind != "abstain", "answerAsOf": "current", "afterSessionIndex": 3, "edgeCases": ["x"],
                "evidence": [{"factId": "f", "sessionIndex": 1, "text": "said", "state": "active"}]}

    def corpus(folder, change=None, agreement=0.95):
        (tmp_path / folder).mkdir()
        rows = [row(i) for i in range(100)]
        if change:
            change(rows)
        probes = {"schemaVersion": "calibration-1.0", "calibrationSetId": folder, "calibrationSetVersion": "1", "frozen": True, "labelingMethod": "by hand", "probes": rows}
        digest = save(folder, "probes.json", probes)
        review = {"calibrationSetId": folder, "probesSha256": digest, "reviewedAt": "now", "reviewMethod": "second pass", "result": "passed",
                  "records": [{"probeId": r["probeId"], "confirmedGoldJudgment": r["goldJudgment"], "justificationConsistent": True, "evidenceConsistent": True, "reviewNote": "ok"} for r in rows[:100]]}
        other = save(folder, "review.json", review)
        save(folder, "manifest.json", {"schemaVersion": "calibration-manifest-1.0", "calibrationSetId": folder, "calibrationSetVersion": "1", "retainedWithScorerVersion": "1",
                                       "frozenAt": "now", "files": {"probes.json": digest, "review.json": other}, "requiredAgreement": agreement})
    corpus("valid")
    changes = {"C07": lambda r: r.__delitem__(slice(85, None)), "C08": lambda r: [x.update(ability="abstention") for x in r[:15]], "C11": lambda r: r[1].update(probeId="p0"),
               "C12": lambda r: r[0].update(justification=""), "C14": lambda r: r[0].update(afterSessionIndex=0), "C16": lambda r: r[0]["evidence"][0].update(sessionIndex=3),
               "C19": lambda r: r[0]["expected"].update(requiredFactIds=["g"]), "C20": lambda r: r[0]["expected"].update(forbiddenFactIds=["f"]),
               "C21": lambda r: r[0]["evidence"][0].update(state="expired"), "C22": lambda r: r[0]["expected"].update(requiredClaims=[]),
               "C23": lambda r: r[6]["expected"].update(tolerance="-1"), "C24": lambda r: r[8]["expected"].update(items=["green", "blue"]), "C25": lambda r: r[9].update(answerability=True)}
    for name, change in changes.items():
        corpus(name, change)
    corpus("C04", agreement=0.9)
    headers, rows, reviews = calibration_json.read_corpora(spark, str(tmp_path))
    seen = by_scope(R.calibration_violations(rows, reviews, headers))
    assert "valid" not in seen, seen["valid"]
    assert not {n: seen.get(n) for n in [*changes, "C04"] if n not in seen.get(n, set())}


def test_leaks_are_found_by_name_at_any_depth(spark):
    rows = spark.createDataFrame([(1, '{"a":[{"Expected-Answer":1}]}'), (2, '{"text":"expected: \\"facts\\": 1"}'), (3, '{"matchType":{"facts":[]}}')], "id int, body string")
    assert {r.id: r.names for r in X.leaking_rows(rows, "id", "body").collect()} == {1: ["expectedanswer"], 3: ["facts", "matchtype"]}
    assert {(r.id, r.path) for r in X.gold_leaks(rows, "id", "body").collect()} == {(1, "$.a[0].Expected-Answer"), (3, "$.matchType"), (3, "$.matchType.facts")}


def test_request_identity_ignores_claimed_counts_only(spark):
    rows = spark.createDataFrame([("r", "a", [("s", 1)]), ("r", "a", [("s", 2)]), ("r", "a", [("t", 1)])],
                                 "runId string, requestId string, tierSegments array<struct<content:string, tokenCount:int>>")
    ids = [r.identity for r in A.request_identity(rows, ["runId"]).collect()]
    assert ids[0] == ids[1] != ids[2]
    full = spark.createDataFrame([("r", 1, "ok")], "runId string, totalTokens int, status string")
    assert A.archived_request(full).columns == ["runId", "totalTokens"]


def test_split_and_canonical_writes(spark, tmp_path):
    from mnemoscope.operators import generate as G
    from mnemoscope.sources import fixture_json
    documents = fixture_json.to_documents(G.generate(spark.createDataFrame([(3, 10)], "seed long, scale int")))
    fixture_json.write_split(documents, str(tmp_path / "agent"), str(tmp_path / "scorer"))
    agent = json.loads(spark.read.text(str(tmp_path / "agent")).first().value)
    assert set(agent) == {"fixtureId", "sessions", "probes"} and set(agent["sessions"][0]["turns"][0]) == {"turnId", "role", "text"}
    assert set(agent["probes"][0]) == {"probeId", "afterSessionId", "question"}
    view = spark.read.text(str(tmp_path / "agent")).withColumn("id", F.lit(1))
    assert X.leaking_rows(view, "id", "value").isEmpty()
    publish.write_canonical(spark.createDataFrame([(2, None, "é")], "b int, a string, c string"), str(tmp_path / "rows"))
    assert spark.read.text(str(tmp_path / "rows")).first().value == '{"a":null,"b":2,"c":"é"}'


def test_declared_counts_against_the_archive(spark):
    from mnemoscope.quality.manifest_rules import count_violations
    columns = "runId string, totalCount int, answeredCount int, unattemptedCount int, requestCount int"
    declared = spark.createDataFrame([("a", 4, 2, 1, 9), ("b", 4, 2, 1, 9), ("ghost", 1, 1, 1, 1)], columns)
    actual = spark.createDataFrame([("a", 4, 2, 1, 9), ("b", 4, 3, 1, 8)], columns)
    rows = {(r.scope, r.path) for r in count_violations(declared, actual).collect()}
    assert rows == {("b", "answeredCount"), ("b", "requestCount")} | {("ghost", c) for c in ("totalCount", "answeredCount", "unattemptedCount", "requestCount")}


def test_segment_tokens_count_mapped_fragments(spark):
    segment = "array<struct<messageIndices:array<int>, toolNames:array<string>, tokenCount:bigint>>"
    rows = spark.createDataFrame([([([0, 1], None, 0), (None, ["t"], 0), ([1], ["t"], 7)], ["{1}", "{22}"], {"t": "{333}"})],
                                 f"segments {segment}, messages array<string>, tools map<string,string>")
    counted = rows.select(A.attribute_tokens(F.col("segments"), F.col("messages"), F.col("tools")).alias("s")).first().s
    assert [s.tokenCount for s in counted] == [len("[{1},{22}]"), len("[{333}]"), len("[{22},{333}]")]


def test_retry_policy(spark):
    history = "array<struct<attempt:int, status:string, backoffSeconds:double, rateWaitSeconds:double>>"
    rows = spark.createDataFrame([
        ("ok", 3, [(1, "429", 1.0, None), (2, "503", 2.0, 3.0), (3, "ok", None, None)]), ("final", 2, [(1, "500", 1.0, None), (2, "ok", None, None)]),
        ("many", 5, [(i, "429", float(2 ** (i - 1)), None) for i in range(1, 5)] + [(5, "ok", None, None)]), ("short", 2, [(1, "429", 3.0, None), (2, "ok", None, None)]),
        ("edge", 2, [(1, "429", 1.0, 29.0), (2, "ok", None, None)]), ("long", 2, [(1, "429", 1.0, 29.1), (2, "ok", None, None)]), ("count", 1, [(1, "429", 1.0, None), (2, "ok", None, None)])],
        f"requestId string, attempts int, retryHistory {history}").withColumn("runId", F.lit("r"))
    assert {r.requestId: r.problem for r in A.retry_audit(rows).collect()} == {
        "ok": None, "final": "a final status was retried", "many": "more than four attempts", "short": "back-off differs from 1, 2, 4 seconds", "edge": None,
        "long": "retry wait above 30 seconds", "count": "attempts differ from history"}


def test_identities_of_digits_keep_their_zeros(spark, tmp_path):
    target = str(tmp_path / "scores")
    publish.publish(spark.createDataFrame([("0012", 1)], "identity string, v int"), target)
    publish.publish(spark.createDataFrame([("0012", 9), ("12", 3)], "identity string, v int"), target)
    assert sorted(r.identity for r in publish.published_identities(spark, target).collect()) == ["0012", "12"]
    assert publish.unpublished(spark.createDataFrame([("0012", 1), ("012", 2)], "identity string, v int"), publish.published_identities(spark, target)).first().v == 2


def test_rows_of_one_small_file_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """Costly rows: manifests, documents to compare and answers of a table in one row group are not left to one task."""
    from mnemoscope.plans import matching_queries, rule_queries

    spark.range(400).selectExpr("id AS c_custkey", "id % 9 AS c_nationkey", "'n' AS c_name", "'SEG' AS c_mktsegment", "double(id) AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(9).selectExpr("id AS n_nationkey").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(400).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.0D AS l_extendedprice", "0.1D AS l_tax", "0.1D AS l_discount",
                                "double(id % 50) AS l_quantity", "'N' AS l_returnflag", "'O' AS l_linestatus").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    given = []
    monkeypatch.setattr(rule_queries, "run_manifest_violations", lambda manifests, fixtures: given.append(manifests) or manifests.withColumn("ruleId", F.lit("M00")))
    monkeypatch.setattr(rule_queries.X, "typed_differences", lambda rows, *names: given.append(rows) or rows)
    rule_queries.m_rules(spark, str(tmp_path))
    rule_queries.p03_typed(spark, str(tmp_path))
    for rows in (*given, matching_queries.line_answers(spark, str(tmp_path)), rule_queries.verdict_rows(spark, str(tmp_path))):
        assert rows.count() == 400 and rows.select(F.spark_partition_id()).distinct().count() > 1
