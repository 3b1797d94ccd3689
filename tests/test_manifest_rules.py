from builders import by_scope, digest, mutated, report_manifest
from pyspark.sql import functions as F

from mnemoscope.quality import manifest_rules as M


def rehash(manifest):
    manifest["configHash"] = digest(manifest["sourceConfiguration"])


def test_each_report_mutation_breaks_its_rule(spark):
    def zero_time(m):
        m.update(actualRunTimeSeconds=0, effectiveThroughputRequestsPerSecond=None)

    changes = {
        "M20": lambda m: m.pop("warnings"), "M01": lambda m: m.update(runId=" "), "M02": lambda m: m["adapter"].update(contractVersion="1.0"),
        "M04": lambda m: m.update(stablePrefix=[]), "M05": lambda m: m.update(nativeModelEnvelopeVersion="2.0"),
        "M06": lambda m: m["model"].pop("provider"), "M07": lambda m: m.update(rateLimitRpm=True),
        "M08": lambda m: m.update(timestamp="2026-01-01T00:00:00"), "M21": lambda m: m.update(schemaVersion="x"),
        "M23": lambda m: m.update(scorerHash="AB" * 32), "M25": lambda m: m.update(seed=1.5), "M26": lambda m: m["runtime"].update(name="b"),
        "M28": lambda m: m["model"].update(deterministic="no"), "M29": lambda m: m.update(providerVersionPinned=True),
        "M30": lambda m: m.update(concurrency={"mode": "solo", "factor": 2}), "M31": lambda m: m["sourceConfiguration"].pop("seed"),
        "M32": lambda m: m.update(configHash="cd" * 32), "M33": lambda m: (m["sourceConfiguration"].update(rateLimitRpm=5), rehash(m)),
        "M34": lambda m: m.update(stablePrefixHash="cd" * 32), "M35": lambda m: m["results"].update(status="running"),
        "M36": lambda m: m["results"].update(valid=1), "M37": lambda m: m["results"].update(accuracyDenominator=4),
        "M38": lambda m: m["results"].update(lastCompletedSession=11), "M39": lambda m: m["results"]["failureCounts"].update(budget=0),
        "M40": lambda m: m["results"].update(completionRate=0.51), "M41": lambda m: m["results"].update(investigationRequired=False),
        "M42": lambda m: m["everyRequestTierTotals"][1].update(requestId="r1"),
        "M42b": lambda m: m["everyRequestTierTotals"][1]["tierTokens"].pop("semi-stable"),
        "M43": lambda m: m.update(effectiveThroughputRequestsPerSecond=0.51), "M44": lambda m: m.update(artifactSizeBytes=5_000_000_001),
        "M45": lambda m: m["recovery"].update(resumed=None), "M46": lambda m: m.update(interruptionResumeHistory=[{"type": "x"}]),
        "M47": lambda m: m.update(canonical=None), "M48": lambda m: m["calibrationHashes"].pop("review.json"),
        "M49": lambda m: m["calibration"].update(approved=False), "M50": lambda m: m.update(judge={}),
        "M51": lambda m: m.update(canonical=True), "M52": lambda m: m["artifactHashes"].pop("report.json"),
        "ok_zero_time": zero_time,
        "ok_boundary": lambda m: m.update(artifactSizeBytes=5_000_000_000),
    }
    rows = spark.createDataFrame(mutated(report_manifest(), changes), "runId string, text string")
    seen = by_scope(M.report_manifest_violations(rows))
    assert "valid" not in seen
    for name in changes:
        if name.startswith("ok"):
            assert name not in seen, (name, seen[name])
        else:
            assert name[:3] in seen.get(name, set()), (name, seen.get(name))


def test_run_manifests_against_their_fixture(spark):
    config = {k: v for k, v in report_manifest()["sourceConfiguration"].items()}
    run = dict(config, timestamp="2026-01-01T00:00:00Z", fixtureId="fx", fixtureSeed=3, generatorVersion="1.0.0",
               configHash=digest(config), stablePrefixHash=digest(["contract"]))
    changes = {
        "M10": lambda m: (m.update(fixtureHash="cd" * 32)), "M11": lambda m: m.update(fixtureSeed=4), "M12": lambda m: m.update(seed=True),
        "M13": lambda m: m.update(probeTimeoutSeconds=2), "M14": lambda m: m.update(stablePrefix=["other"]),
        "M15": lambda m: m.update(concurrency={"mode": "many", "factor": 2}), "M16": lambda m: m["model"].update(api_key="k"),
        "M09": lambda m: m.pop("harnessHash")}
    rows = spark.createDataFrame(mutated(run, changes) + [("M00", '{"a":1,"a":2}')], "runId string, text string")
    fixtures = spark.createDataFrame([("fx", "ab" * 32, "1.0.0", 3)], "fixtureId string, contentHash string, generatorVersion string, seed long")
    seen = by_scope(M.run_manifest_violations(rows, fixtures))
    assert "valid" not in seen
    for name in [*changes, "M00"]:
        assert name in seen.get(name, set()), (name, seen.get(name))


def test_footprint_boundary(spark):
    rows = spark.range(2).select(F.size(M.footprint_warnings(F.col("id") + 5_000_000_000)).alias("n")).orderBy("n").collect()
    assert [r.n for r in rows] == [0, 1]
