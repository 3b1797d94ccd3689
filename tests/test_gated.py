from mnemoscope.plans import jobs as P
from mnemoscope.sources import published

EXPECTED = "struct<matchType:string, acceptedAnswers:array<string>, targetNumber:string, tolerance:string, toleranceMode:string, requiredClaims:array<string>, disallowedContradictions:array<string>>"
TIERS = "struct<stable:bigint, `semi-stable`:bigint, unstable:bigint>"


def archive(spark, runs):
    exact = ("exact", ["blue"], None, None, None, None, None)
    gold = spark.createDataFrame([(r, "p", True, "s", exact) for r in runs], f"runId string, probeId string, answerability boolean, afterSessionId string, expected {EXPECTED}")
    captured = spark.createDataFrame([(r, "p", "s", "ok", None, True, "BLUE", ["q"], [("q", "h")]) for r in runs],
                                     "runId string, probeId string, sessionId string, status string, category string, eligibleForAccuracy boolean, answer string,"
                                     "requestIds array<string>, requests array<struct<requestId:string, hash:string>>")
    requests = spark.createDataFrame([(r, "p", "q", "ok", None, 5, 0, (1, 1, 1)) for r in runs],
                                     f"runId string, probeId string, requestId string, status string, category string, totalTokens bigint, requestOverheadTokens bigint, tierTokens {TIERS}")
    lifecycle = spark.createDataFrame([(r, "completed") for r in runs], "runId string, status string")
    return P.Archive(gold, captured, requests, lifecycle)


def runs_of(spark, rows):
    return spark.createDataFrame(rows, "runId string, fixtureHash string, manifestHash string, tokenizer string, calibrationSetId string")


def decided(spark, rows):
    return spark.createDataFrame(rows, "calibrationSetId string, approved boolean, rejectionReasons array<string>, calibrationHash string")


def test_gates_and_identities(spark, tmp_path):
    path, names = str(tmp_path / "scores"), ["a", "b", "c", "d", "e"]
    runs = runs_of(spark, [("a", "f", "ma", "t", "yes"), ("b", "f", "mb", "t", "no"), ("c", "f", "mc", "t", "lost"), ("d", "f", "md", "t", None),
                           ("e", "f", "me", "t", "yes"), ("e", "f", "me", "t", "yes")])
    decisions = decided(spark, [("yes", True, [], "1"), ("no", False, ["agreement 1/2 is below required 95%", "more"], "2")])
    scorer = P.Scorer("1", "code")
    given = archive(spark, names)
    refused = {r.runId: (r.reason, r.detail) for r in P.score_gated(given, runs, decisions, scorer, path).collect()}
    assert refused == {"b": ("calibration", "agreement 1/2 is below required 95%; more"), "c": ("calibration", "no calibration"),
                       "d": ("calibration", "no calibration"), "e": ("manifest", "the run is named twice")}
    rows = published.published(spark, path).collect()
    assert [(r.runId, r.judgment, r.normalizedAnswer, r.scorerVersion) for r in rows] == [("a", "pass", "blue", "1")]
    # The same scoring is not published twice, another calibration is another identity.
    again = {r.runId: r.reason for r in P.score_gated(given, runs, decisions, scorer, path).collect()}
    assert again["a"] == "publication" and published.published(spark, path).count() == 1
    P.score_gated(given, runs, decided(spark, [("yes", True, [], "3")]), scorer, path)
    assert published.published(spark, path).count() == 2 and published.identities(spark, path).count() == 2


def test_no_runs_and_smoke_tokenizer(spark, tmp_path):
    path = str(tmp_path / "scores")
    decisions = decided(spark, [("yes", True, [], "1")])
    assert P.score_gated(archive(spark, []), runs_of(spark, []), decisions, P.Scorer("1", "c"), path).isEmpty()
    smoke = runs_of(spark, [("a", "f", "m", "characters-smoke", "yes")])
    assert P.preflight(archive(spark, ["a"]), smoke, decisions).first().reason == "tokenizer"
    assert P.preflight(archive(spark, ["a"]), smoke, decisions, canonical=False).isEmpty()


def test_masked_columns_share_one_python_worker_of_a_task(spark):
    columns = "rawAnswer string, normalizedAnswer string, judgeOutput string"
    rows = spark.createDataFrame([(f"a {form} b", f"a {form}", f'{{"reasoning":"{form} seen"}}') for form in ("order key", "ORDER \u212aey")] + [(None, None, None)], columns)
    masked = P.without_secrets(rows, ("order key",))
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [tuple(r) for r in masked.collect()] == 2 * [("a [REDACTED] b", "a [REDACTED]", '{"reasoning":"[REDACTED] seen"}')] + [(None, None, None)]
