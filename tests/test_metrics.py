import pytest
from pyspark.sql import functions as F

from mnemoscope.operators import metrics as M

GOLD = "runId string, fixtureId string, probeId string, ability string, answerability boolean, sessionDistance int, evidenceCardinality int"
CAPTURED = "runId string, probeId string, category string, latencyMs double, eligibleForAccuracy boolean"
SCORES = "runId string, probeId string, judgment string, correct boolean"


def outcome(spark, probes):
    """probes: (judgment, answerable, category or None) per probe of one run; category 'unattempted' was not captured."""
    gold, captured, scores = [], [], []
    for i, (judgment, answerable, category) in enumerate(probes):
        key = ("run", f"p{i}")
        gold.append(("run", "fx", f"p{i}", "recall", answerable, 2, 1))
        if category != "unattempted":
            captured.append((*key, category, 20.0 + i, category is None))
        scores.append((*key, judgment, (judgment == "pass" and answerable) or (judgment == "abstain" and not answerable)))
    return M.outcomes(spark.createDataFrame(gold, GOLD), spark.createDataFrame(captured, CAPTURED), spark.createDataFrame(scores, SCORES)).cache()


def test_accuracy_and_completion_have_their_own_denominators(spark):
    rows = outcome(spark, [("pass", True, None), ("fail", True, None), ("incomplete", True, "provider"), ("incomplete", True, "unattempted")])
    row = M.accuracy(rows).first()
    assert (row.correct, row.answered, row.total, row.accuracy, row.completionRate) == (1, 2, 4, 0.5, 0.5)
    groups = {(r.dimension, r.label): r for r in M.breakdown(rows).collect()}
    assert groups["ability", "recall"].total == 4 and groups["sessionDistance", "2"].answered == 2
    assert groups["fixtureId", "fx"].correct == 1 and groups["evidenceCardinality", "1"].accuracy == 0.5
    assert M.failures(rows).first().asDict() == {"runId": "run", "budget": 0, "provider": 1, "adapter": 0, "timeout": 0, "unattemptedCount": 1}


def test_undefined_rates_are_null_never_zero(spark):
    rows = outcome(spark, [("incomplete", True, "budget")])
    row = M.accuracy(rows).first()
    assert row.accuracy is None and row.completionRate == 0
    assert M.abstention(rows).first().falseAbstentionRate is None
    assert M.accuracy(rows.filter("false"), []).first().completionRate is None


@pytest.mark.parametrize("failed, required", [(1, False), (2, True)])
def test_investigation_starts_strictly_above_five_percent(spark, failed, required):
    probes = [("incomplete", True, "timeout")] * failed + [("incomplete", True, "budget")] + [("pass", True, None)] * (19 - failed)
    row = M.incomplete(outcome(spark, probes)).first()
    assert row.investigationRequired is required and row.incompleteCount == failed


def test_abstention_counts_answered_probes_by_judgment(spark):
    rows = outcome(spark, [("abstain", False, None), ("fail", False, None), ("abstain", True, None), ("fail", True, None),
                           ("incomplete", False, "adapter")])
    row = M.abstention(rows).first()
    assert (row.correctAbstentions, row.unsupportedAnswers, row.falseAbstentions) == (1, 1, 1)
    assert (row.correctAbstentionRate, row.unsupportedAnswerRate, row.falseAbstentionRate) == (0.5, 0.5, 0.5)


def test_distribution_is_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", None)], "runId string, latencyMs double")
    result = {r.runId: r for r in M.latency(rows).collect()}
    assert result["a"].asDict() == {"runId": "a", "count": 20, "mean": 10.5, "p50": 10.0, "p95": 19.0, "min": 1.0, "max": 20.0}
    assert result["b"].asDict() == {"runId": "b", "count": 0, "mean": None, "p50": None, "p95": None, "min": None, "max": None}


def test_all_requests_count_for_tokens(spark):
    tiers = "struct<stable:bigint, `semi-stable`:bigint, unstable:bigint>"
    rows = spark.createDataFrame([("run", 100, (20, 30, 45), 5), ("run", 100, (20, 30, 45), 5), ("run", 300, (50, 100, 140), 10)],
                                 f"runId string, totalTokens bigint, tierTokens {tiers}, requestOverheadTokens bigint")
    totals = M.tokens(rows)
    row = totals.first()
    assert (row.stable, row.semi_stable, row.unstable, row.requestOverheadTokens, row.totalInputTokens) == (90, 160, 230, 20, 500)
    assert row.stable_share == 90 / 480
    accuracy = spark.createDataFrame([("run", 1.0), ("none", None)], "runId string, accuracy double")
    result = {r.runId: r.accuracyPer1000InputTokens for r in M.token_efficiency(accuracy, totals).collect()}
    assert abs(result["run"] - 6) < 1e-12 and result["none"] is None


def relevance(spark, sources, required=("f1", "f3")):
    """sources per probe: None for not reported, else a list of source ids."""
    gold = spark.createDataFrame([("run", "fx", f"p{i}") for i in range(len(sources))], "runId string, fixtureId string, probeId string")
    segment = "array<struct<sourceIds:array<string>>>"
    requests = spark.createDataFrame([("run", f"p{i}", [(s,)]) for i, s in enumerate(sources)], f"runId string, probeId string, tierSegments {segment}")
    turns = spark.createDataFrame([("fx", "t1", ["f1", "f2"], []), ("fx", "t2", None, ["f1"]), ("fx", "t3", [], None)],
                                  "fixtureId string, turnId string, introducedFactIds array<string>, referencedFactIds array<string>")
    facts = spark.createDataFrame([("fx", "f3", "t4")], "fixtureId string, factId string, introducedAt string")
    needed = spark.createDataFrame([("run", f"p{i}", f) for i in range(len(sources)) for f in required], "runId string, probeId string, factId string")
    per_probe = M.relevance_per_probe(gold, M.retrieved_sources(requests), M.turn_facts(turns, facts), needed).cache()
    return {r.probeId: r for r in per_probe.collect()}, M.relevance(per_probe).first()


def test_sources_stand_for_facts_and_strangers_stay_wrong(spark):
    rows, run = relevance(spark, [["t1", "f1", "stranger"], []])
    assert (rows["p0"].precision, rows["p0"].recall) == (1 / 3, 0.5)
    assert (rows["p1"].precision, rows["p1"].recall, rows["p1"].retrievedCount) == (0.0, 0.0, 0)
    assert run.status == "reported" and run.precision == pytest.approx(1 / 6)


def test_references_ledger_and_empty_turns(spark):
    rows, _ = relevance(spark, [["t2"], ["t4"], ["f1", "t3"]], required=("f1",))
    assert (rows["p0"].precision, rows["p0"].recall) == (1.0, 1.0)
    assert (rows["p1"].precision, rows["p1"].recall) == (0.0, 0.0)
    assert rows["p2"].precision == 0.5


def test_missing_provenance_is_not_empty_provenance(spark):
    rows, run = relevance(spark, [None, ["f1"]], required=("f1",))
    assert rows["p0"].status == "not-reported" and rows["p0"].precision is None
    assert (run.status, run.precision, run.reportedPrecision) == ("partial", None, 1.0)
    assert relevance(spark, [None])[1].status == "not-reported"


def test_empty_gold_relevance_is_undefined(spark):
    rows, _ = relevance(spark, [[]], required=())
    assert rows["p0"].precision is None and rows["p0"].recall is None


def test_distance_labels_win_over_the_oldest_evidence(spark):
    probes = spark.createDataFrame([("fx", "a", 5, None), ("fx", "b", 5, 99), ("fx", "c", 5, None), ("fx", "d", 1, None)],
                                   "fixtureId string, probeId string, checkpoint int, sessionDistance int")
    required = spark.createDataFrame([("fx", p, f) for p in "abd" for f in ("f1", "f2")], "fixtureId string, probeId string, factId string")
    facts = spark.createDataFrame([("fx", "f1", "t1"), ("fx", "f2", "t3")], "fixtureId string, factId string, introducedAt string")
    turns = spark.createDataFrame([("fx", "t1", 1), ("fx", "t3", 3)], "fixtureId string, turnId string, sessionIndex int")
    rows = {r.probeId: r for r in M.session_distance(probes, required, facts, turns).collect()}
    assert [rows[p].distance for p in "abcd"] == [4, 99, 0, None] and rows["b"].derivedDistance == 4


def test_summary_of_a_run_without_probes_is_complete(spark):
    rows = outcome(spark, [("pass", True, None)])
    requests = spark.createDataFrame([("run",), ("empty",)], "runId string")
    lifecycle = spark.createDataFrame([("run", "completed"), ("empty", "completed")], "runId string, status string")
    result = {r.runId: r for r in M.run_summary(rows, requests, lifecycle).collect()}
    assert result["empty"].completionRate == 1.0 and result["run"].answeredCount == 1 and result["run"].requestCount == 1
    assert M.budget_failures(outcome(spark, [("incomplete", True, "budget")]), spark.createDataFrame(
        [("run", "error", "budget"), ("run", "error", "budget")], "runId string, status string, category string")).first().asDict() == {
        "runId": "run", "overBudgetFailures": 1, "budgetRequestFailures": 2}


def test_counts_of_conditions_treat_null_as_false(spark):
    from mnemoscope.functions.ratio import count_where
    row = spark.createDataFrame([(True,), (None,), (False,)], "x boolean").agg(count_where(F.col("x")).alias("n")).first()
    assert row.n == 1
