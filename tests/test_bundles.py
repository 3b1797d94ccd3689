import hashlib
import json

from pyspark.sql import functions as F

from mnemoscope.plans import bundles as B
from mnemoscope.plans import jobs
from mnemoscope.quality import manifest_rules
from mnemoscope.sources import published

ACCURACY = "runId string, correct bigint, answered bigint, total bigint, accuracy double, completionRate double"
BREAKDOWN = "runId string, dimension string, label string, correct bigint, answered bigint, total bigint, accuracy double, completionRate double"
RUNS = "runId string, arrival bigint, scale int, fixtureHash string, deterministic boolean, model string"


def report(spark, accuracy, breakdown=()):
    parts = dict.fromkeys(jobs.Report.__annotations__)
    parts["accuracy"] = spark.createDataFrame(accuracy, ACCURACY)
    parts["breakdown"] = spark.createDataFrame(list(breakdown), BREAKDOWN)
    return jobs.Report(**parts)


def test_documents_are_canonical_and_in_label_order(spark):
    given = report(spark, [("a", 1, 2, 3, 0.5, None), ("two", 0, 0, 1, None, 0.0), ("two", 0, 0, 1, None, 0.0)],
                   [("a", "distance", d, 1, 1, 1, 1.0, 1.0) for d in ("9", "10", 'q"\\', None)])
    got = {r.runId: r.report for r in B.report_documents(given).collect()}
    assert got["two"] is None
    document = json.loads(got["a"])
    assert got["a"].endswith("\n") and list(document) == sorted(document)
    assert document["accuracy"] == {"correct": 1, "answered": 2, "total": 3, "accuracy": 0.5, "completionRate": None}
    assert list(document["breakdown"]["distance"]) == ["10", "9", "null", 'q"\\']


def made(spark, n=12, artifacts=None):
    given = report(spark, [(f"r{i}", i, i + 1, 2 * i + 1, i / (i + 1), None) for i in range(n)])
    runs = spark.createDataFrame([(f"r{i}", i, 10 if i % 2 else 100, "h" * (i * 9), None, "m") for i in range(n)], RUNS)
    return B.bundles(B.report_documents(given), runs, artifacts)


def test_manifests_count_their_own_bytes(spark):
    files = spark.createDataFrame([(f"r{i}", name, "0" * 64, size) for i in range(12) for name, size in
                                   (("scores.jsonl", 10 ** i - 900), ("requests.jsonl", 50))], "runId string, name string, sha256 string, bytes bigint")
    rows = made(spark, 12, files)
    for row in rows.collect():
        manifest, i = json.loads(row.manifest), int(row.runId[1:])
        assert row.identity == hashlib.sha256(row.manifest.encode()).hexdigest()
        assert manifest["artifactHashes"] == {"scores.jsonl": "0" * 64, "requests.jsonl": "0" * 64,
                                              "report.json": hashlib.sha256(row.report.encode()).hexdigest()}
        size = len(row.manifest.encode()) + len(row.report.encode()) + 10 ** i - 850
        assert manifest["artifactSizeBytes"] == size
        assert manifest["warnings"] == ([manifest_rules.FOOTPRINT_WARNING] if size > manifest_rules.FOOTPRINT_BYTES else [])
    sound = B.checked_bundles(rows, files)
    assert sound.filter("size(problems) > 0").isEmpty()
    assert {tuple(r.problems) for r in B.checked_bundles(rows, files.filter("name <> 'scores.jsonl'")).collect()} == {
        ("other files differ", "total size differs")}


def test_bundles_published_read_back_and_damaged(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = made(spark)
    twice = rows.unionByName(rows.filter("runId = 'r3'")).unionByName(rows.filter("runId = 'r4'").withColumn("identity", F.lit(None).cast("string")))
    refused = {r.reason for r in B.publish_bundles(twice, path).collect()}
    assert refused == {"no identity", "another number of rows than expected"}
    B.publish_bundles(rows, path)
    back = published.published(spark, path)
    assert back.count() == 12 and published.damaged(spark, path).isEmpty()
    changed = back.withColumn("report", F.when(F.col("runId") == "r5", F.lit("no json")).when(F.col("runId") == "r6", F.lit(None)).otherwise(F.col("report")))
    changed = changed.withColumn("identity", F.when(F.col("runId") == "r7", "x").otherwise(F.col("identity")))
    checked = B.checked_bundles(changed)
    problems = {r.runId: r.problems for r in checked.filter("size(problems) > 0").collect()}
    assert problems == {"r5": ["hash differs", "total size differs", "unknown schema version"],
                        "r6": ["hash differs", "total size differs", "unknown schema version"], "r7": ["bundle is not named after its manifest"]}
    curves = jobs.compare_reports(B.curve_reports(checked))
    points = {r.runId: (r.scale, r.correct, r.repeat) for r in curves["points"].collect()}
    assert points == {"r0": (100, 0, 1), "r2": (100, 2, 2), "r4": (100, 4, 3), "r8": (100, 8, 4), "r10": (100, 10, 5),
                      "r1": (10, 1, 1), "r3": (10, 3, 2), "r9": (10, 9, 3), "r11": (10, 11, 4)}
    assert [r.problem for r in curves["violations"].collect()] == []


def test_outcomes_are_joined_once_for_all_parts_of_a_report(spark):
    gold = spark.createDataFrame([("r", "f", f"p{i}", "abstention" if i == 3 else "a", i != 3, i, 1) for i in range(4)],
                                 "runId string, fixtureId string, probeId string, ability string, answerability boolean, sessionDistance int, evidenceCardinality int")
    captured = spark.createDataFrame([("r", f"p{i}", "provider" if i == 2 else None, float(i), i != 2) for i in range(1, 4)],
                                     "runId string, probeId string, category string, latencyMs double, eligibleForAccuracy boolean")
    scores = spark.createDataFrame([("r", "p1", "pass", True), ("r", "p3", "abstain", True)], "runId string, probeId string, judgment string, correct boolean")
    requests = spark.createDataFrame([("r", "p1", "ok", None, 5, (1, 1, 1), 2, 7.0, [(["s"],)])],
                                     "runId string, probeId string, status string, category string, totalTokens bigint, tierTokens struct<stable:bigint, `semi-stable`:bigint, unstable:bigint>,"
                                     "requestOverheadTokens bigint, latencyMs double, tierSegments array<struct<sourceIds:array<string>>>")
    facts = spark.createDataFrame([("f", "s", "x")], "fixtureId string, turnId string, factId string")
    required = spark.createDataFrame([("r", "p1", "x")], "runId string, probeId string, factId string")
    made = jobs.report_runs(gold, captured, scores, requests, facts, required)
    for part in (made.accuracy, made.breakdown, made.abstention, made.operations, made.probe_latency):
        assert part.inputFiles() and all("/outcomes-" in name for name in part.inputFiles())
    document = json.loads(B.report_documents(made).first().report)
    assert document["accuracy"] == {"correct": 2, "answered": 2, "total": 4, "accuracy": 1.0, "completionRate": 0.5}
    assert document["abstention"]["correctAbstentions"] == 1 and document["operationalTelemetry"]["counts"]["incompleteCount"] == 1
    assert document["operationalTelemetry"]["probeLatencyMs"]["max"] == 3 and sorted(document["breakdown"]["sessionDistance"]) == ["0", "1", "2", "3"]


def test_the_size_of_a_manifest_is_bound_not_computed_at_every_use(spark):
    plan = made(spark, 1).select("manifest")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("artifactSizeBytes") <= 8


def test_no_runs(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = made(spark, 0)
    assert B.publish_bundles(rows, path).isEmpty() and B.curve_reports(B.checked_bundles(published.published(spark, path))).isEmpty()
