"""Archives, scores and calibration corpora: one damaged run or corpus per mutation, all checked at once."""

import copy

from builders import by_scope
from pyspark.sql import functions as F

from mnemoscope.operators import calibration as C
from mnemoscope.quality import archive_rules as R

TIERS = "struct<stable:bigint, `semi-stable`:bigint, unstable:bigint>"
REQUEST = f"runId string, requestId string, probeId string, status string, category string, totalTokens bigint, tierTokens {TIERS}, requestOverheadTokens bigint"
CAPTURED = ("runId string, probeId string, sessionId string, status string, category string, eligibleForAccuracy boolean, answer string,"
            "requestIds array<string>, requests array<struct<requestId:string, hash:string>>")
SCORE = ("runId string, probeId string, rawAnswer string, matchingMethod string, judgment string, correct boolean, normalizedAnswer string, judgeOutput string,"
         "eligibleForAccuracy boolean, failureCategory string, fixtureHash string, manifestHash string, scorerVersion string")


def run():
    """Two requests and two captured probes, the second a budget failure; a third probe is a score's only."""
    def request(i, status, category, total):
        return {"requestId": f"r{i}", "probeId": f"p{i}", "status": status, "category": category, "totalTokens": total, "tiers": [1, 2, 3], "overhead": 0}

    def probe(i, ok):
        return {"probeId": f"p{i}", "sessionId": "s-1", "status": "ok" if ok else "error", "category": None if ok else "budget", "eligible": ok,
                "answer": "a" if ok else None, "ids": [f"r{i}"], "requests": [[f"r{i}", f"h{i}"]]}
    return {"requests": [request(1, "ok", None, 25_000), request(2, "error", "budget", 25_001)], "probes": [probe(1, True), probe(2, False)], "status": "completed"}


def test_archive_mutations(spark):
    def first(kind, **change):
        return lambda r: r[kind][0].update(change)
    changes = {
        "R01": first("requests", totalTokens=25_001), "R03": first("requests", status="done"), "R04": first("requests", requestId=" "),
        "R05": lambda r: r["requests"][1].update(requestId="r1"), "R06": first("requests", tiers=[-1, 0, 0]), "R07": first("probes", probeId="ghost"),
        "R08": first("probes", sessionId="s-2"), "R09": first("probes", status="error"), "R10": first("probes", answer=None),
        "R11": lambda r: r["probes"][1].update(category="mood"), "R12": first("probes", requests=[]), "R14": first("probes", ids=["r2"]),
        "R15": lambda r: r["probes"].pop(0), "R16": lambda r: r.update(status="running"), "R17": lambda r: r["requests"][0].update(probeId="ghost"),
        "R18": first("probes", requests=[["r1", "other"]]), "R07b": lambda r: r["probes"].append(dict(r["probes"][0])),
    }
    runs = {"valid": run()}
    for name, change in changes.items():
        runs[name] = run()
        change(runs[name])
    requests = spark.createDataFrame([(n, q["requestId"], q["probeId"], q["status"], q["category"], q["totalTokens"], tuple(q["tiers"]), q["overhead"])
                                      for n, r in runs.items() for q in r["requests"]], REQUEST)
    captured = spark.createDataFrame([(n, p["probeId"], p["sessionId"], p["status"], p["category"], p["eligible"], p["answer"], p["ids"], [tuple(x) for x in p["requests"]])
                                      for n, r in runs.items() for p in r["probes"]], CAPTURED)
    gold = spark.createDataFrame([(n, f"p{i}", "s-1") for n in runs for i in (1, 2)], "runId string, probeId string, afterSessionId string")
    lifecycle = spark.createDataFrame([(n, r["status"]) for n, r in runs.items()], "runId string, status string")
    identities = requests.select("runId", "requestId", "probeId", "status", F.concat(F.lit("h"), F.substring("requestId", 2, 1)).alias("hash"))
    seen = by_scope(R.archive_violations(requests, captured, gold, lifecycle, identities))
    assert "valid" not in seen, seen["valid"]
    assert not {n: seen.get(n) for n in changes if n[:3] not in seen.get(n, set())}


def test_retokenized_requests_must_agree(spark):
    row = ("run", "r1", None, "ok", None, 10, (1, 2, 3), 0)
    requests = spark.createDataFrame([row, (*row[:1], "r2", *row[2:])], REQUEST)
    counted = requests.withColumn("retokenized", F.struct(
        F.when(F.col("requestId") == "r2", 11).otherwise(10).cast("bigint").alias("totalTokens"), "tierTokens", "requestOverheadTokens"))
    none = spark.createDataFrame([], CAPTURED)
    gold = spark.createDataFrame([], "runId string, probeId string, afterSessionId string")
    lifecycle = spark.createDataFrame([("run", "completed")], "runId string, status string")
    rows = R.archive_violations(counted, none, gold, lifecycle).collect()
    assert [(r.ruleId, r.path) for r in rows] == [("R02", "r2")]


def test_score_mutations(spark):
    base = {"p1": ("a", "exact", "pass", True, "a", None, True, None), "p2": (None, "not-scored", "incomplete", False, None, None, False, "budget"),
            "p3": (None, "not-scored", "incomplete", False, None, None, False, "unattempted"), "p4": ("b", "semantic", "abstain", True, "b", "{}", True, None)}

    def change(probe, at, value):
        def apply(rows):
            row = list(rows[probe])
            row[at] = value
            rows[probe] = tuple(row)
        return apply
    changes = {"K01": lambda r: r.update(ghost=r["p1"]), "K03": change("p1", 6, False), "K04": change("p1", 0, "x"), "K05": change("p3", 7, None),
               "K06": change("p1", 3, None), "K07": change("p2", 3, True), "K08": change("p1", 1, "numeric"), "K09": change("p4", 5, None),
               "K09b": change("p1", 5, "{}"), "K10": change("p1", 3, False), "K11": lambda r: r.pop("p3"), "K10b": change("p4", 3, False)}
    runs = {"valid": dict(base)}
    for name, apply in changes.items():
        runs[name] = copy.copy(base)
        apply(runs[name])
    scores = spark.createDataFrame([(n, p, *row, "fh", "mh", "1") for n, rows in runs.items() for p, row in rows.items()] + [
        ("K02", p, *row, "other", "mh", "1") for p, row in base.items()], SCORE)
    names = [*runs, "K02"]
    gold = spark.createDataFrame([(n, p, kind, answerable) for n in names for p, kind, answerable in (
        ("p1", "exact", True), ("p2", "exact", True), ("p3", "exact", True), ("p4", "semantic", False))], "runId string, probeId string, matchType string, answerability boolean")
    captured = spark.createDataFrame([(n, *row) for n in names for row in (("p1", True, "a", None), ("p2", False, None, "budget"), ("p4", True, "b", None))],
                                     "runId string, probeId string, eligibleForAccuracy boolean, answer string, category string")
    manifests = spark.createDataFrame([(n, "fh", "mh", "1") for n in names], "runId string, fixtureHash string, manifestHash string, scorerVersion string")
    seen = by_scope(R.score_violations(scores, gold, captured, manifests))
    assert "valid" not in seen, seen["valid"]
    assert not {n: seen.get(n) for n in [*changes, "K02"] if n[:3] not in seen.get(n, set())}


def agreed(spark, matched):
    rows = [("set", i, "pass") for i in range(100)]
    said = [("set", i, "pass" if i < matched else "fail") for i in range(100)]
    return C.agreements(spark.createDataFrame(rows, "calibrationSetId string, probeId int, goldJudgment string"),
                        spark.createDataFrame(said, "calibrationSetId string, probeId int, judgment string"), ["calibrationSetId", "probeId"])


def test_gate_accepts_95_and_rejects_94(spark):
    for matched, approved in ((95, True), (94, False)):
        row = C.gate(agreed(spark, matched), ["calibrationSetId"]).first()
        assert (row.matched, row.total, row.approved) == (matched, 100, approved)


def test_gate_needs_human_labels_for_canonical_use(spark):
    corpora = spark.createDataFrame([
        ("set", "h", "by hand", "second pass", "human", "ann", "human", "bo"), ("agent", "h", "same Agent", "x", "human", "ann", "human", "bo"),
        ("blank", "h", "x", "x", "human", " ", "human", "bo"), ("frozen", "f", "x", "x", "human", "ann", "human", "bo"), ("said", "h", "x", "x", "agent", None, None, None)],
        "calibrationSetId string, rowsHash string, labelingMethod string, reviewMethod string, labelKind string, labelerId string, reviewKind string, reviewerId string")
    kinds = {r.calibrationSetId: r.kind for r in C.provenance(corpora, frozen_rows_hashes=("f",)).collect()}
    assert kinds == {"set": "human", "agent": "agent", "blank": "unknown", "frozen": "agent", "said": "agent"}
    gated = C.gate(agreed(spark, 99), ["calibrationSetId"])
    decided = C.decision(gated, C.provenance(corpora)).first()
    assert decided.approved and decided.canonical
    unknown = C.decision(gated, C.provenance(corpora).withColumn("kind", F.lit("agent")))
    assert not unknown.first().approved and C.decision(gated, C.provenance(corpora), require_human=False).first().canonical is False


def test_scorer_output_domain(spark):
    rows = spark.createDataFrame([(1, "pass", True, "exact"), (2, "maybe", True, "exact"), (3, "pass", None, "exact"), (4, "pass", True, "regex")],
                                 "probeId int, judgment string, correct boolean, matchingMethod string")
    assert {r.probeId: r.problem for r in C.prediction_violations(rows, ["probeId"]).collect()} == {2: "judgment", 3: "correct", 4: "matchingMethod"}
    labelled = rows.withColumn("goldJudgment", F.lit("x")).withColumn("edgeCases", F.array())
    assert C.without_labels(labelled).columns == rows.columns
