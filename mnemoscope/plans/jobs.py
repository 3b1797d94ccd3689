"""The end-to-end jobs: score finished runs, report on them, compare reports, calibrate a scorer,
generate and validate corpora.  Each takes and returns tables of many runs."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoscope.functions.canonical import struct_digest
from mnemoscope.functions.ratio import holds, ratio
from mnemoscope.functions.secret_forms import mask_forms, mask_judge_output
from mnemoscope.operators import calibration as C
from mnemoscope.operators import curves as V
from mnemoscope.operators import generate as G
from mnemoscope.operators import matching as X
from mnemoscope.operators import metrics as M
from mnemoscope.operators.joins import lookup_join
from mnemoscope.quality.archive_rules import archive_violations
from mnemoscope.quality.fixture_rules import fixture_violations
from mnemoscope.quality.framework import assert_valid
from mnemoscope.session import materialized
from mnemoscope.sources import published as P

KEY = ["runId", "probeId"]
RESULT = ["judgment", "correct", "normalizedAnswer", "matchingMethod", "judgeOutput", "goldError"]


def score_runs(gold, captured, runs, scorer_version, verdicts=None, pinned_model=None):
    """Scores of every gold probe of every run, attempted or not.

    gold: runId, probeId, answerability, expected; captured: runId, probeId, eligibleForAccuracy, answer,
    category; runs: runId, fixtureHash, manifestHash; verdicts: runId, probeId, output, model for
    semantic probes.  Scoring assumes a clean archive; ``score_gated`` checks it first.
    """
    attempt = captured.select(*KEY, "answer", "category", F.col("eligibleForAccuracy").alias("_eligible"), F.lit(True).alias("_captured"))
    rows = gold.join(attempt, KEY, "left").withColumn("eligible", F.coalesce("_eligible", F.lit(False)))
    answered = rows.filter("eligible")
    semantic = F.col("expected.matchType") == "semantic"
    judged = X.match_answers(answered.filter(~semantic), split=False).withColumn("judgeOutput", F.lit(None).cast("string")).select(*KEY, *RESULT)
    if verdicts is not None:
        by_judge = X.apply_verdicts(answered.filter(semantic), verdicts, KEY, pinned_model)
    else:
        # Without a table of verdicts no semantic record has one.
        types = dict(judged.dtypes)
        missing = {c: F.lit(None).cast(types[c]) for c in RESULT} | {"goldError": F.lit("no verdict for the record")}
        by_judge = answered.filter(semantic).select(*KEY, *[c.alias(n) for n, c in missing.items()])
    judged = judged.unionByName(by_judge.select(*KEY, *RESULT))
    rows = rows.join(judged, KEY, "left")
    scored = F.col("eligible")
    result = rows.select(
        *KEY, F.col("answer").alias("rawAnswer"),
        F.when(scored, F.col("matchingMethod")).otherwise("not-scored").alias("matchingMethod"),
        F.when(scored, F.col("judgment")).otherwise("incomplete").alias("judgment"),
        F.when(scored, F.col("correct")).otherwise(F.lit(False)).alias("correct"), "normalizedAnswer", "judgeOutput",
        scored.alias("eligibleForAccuracy"),
        F.when(F.col("_captured").isNull(), "unattempted").otherwise(F.col("category")).alias("failureCategory"), "goldError")
    identity = runs.select("runId", "fixtureHash", "manifestHash")
    return lookup_join(result, identity, ["runId"], "left", spread=["probeId"]).withColumn("scorerVersion", F.lit(scorer_version))


def without_secrets(scores, secrets):
    """Score rows fit for publication: answers and judge output without secrets in any written form."""
    return scores.withColumns({"rawAnswer": mask_forms(F.col("rawAnswer"), secrets),
                               "normalizedAnswer": mask_forms(F.col("normalizedAnswer"), secrets),
                               "judgeOutput": mask_judge_output(F.col("judgeOutput"), secrets)})


@dataclass
class Archive:
    """Tables of finished runs, with the columns that ``archive_violations`` and ``score_runs`` name."""

    gold: DataFrame
    captured: DataFrame
    requests: DataFrame
    lifecycle: DataFrame
    identities: DataFrame | None = None


@dataclass
class Scorer:
    """What identifies a scorer: its version, the hash of its code, the judge's configuration as text."""

    version: str
    code_hash: str
    judge: str | None = None
    pinned_model: str | None = None


def preflight(archive, runs, decisions, canonical=True):
    """Why runs may not be scored: (runId, reason, detail), each reason once for a run.

    runs: runId, fixtureHash, manifestHash, tokenizer, calibrationSetId; decisions: from ``calibrate``, with
    calibrationHash.  A run named twice, an archive that breaks rules, a smoke tokenizer in canonical use, and a
    calibration that did not approve the scorer are reasons.
    """
    broken = archive_violations(archive.requests, archive.captured, archive.gold, archive.lifecycle, archive.identities)
    broken = broken.groupBy(F.col("scope").alias("runId"), F.col("ruleId").alias("reason")).agg(F.min("detail").alias("detail"))
    twice = runs.groupBy("runId").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "runId", F.lit("manifest").alias("reason"), F.lit("the run is named twice").alias("detail"))
    approved = decisions.select("calibrationSetId", F.lit(True).alias("_known"), "approved", "rejectionReasons")
    rows = lookup_join(runs, approved, ["calibrationSetId"], "left", spread=["runId"])
    calibration = (F.when(F.col("_known").isNull(), "no calibration").when(
        ~holds(F.col("approved")), F.coalesce(F.array_join("rejectionReasons", "; "), F.lit("not approved"))))
    smoke = F.when(F.lit(canonical) & holds(F.col("tokenizer") == "characters-smoke"), "characters-smoke gives no canonical results")
    named = F.explode(F.filter(F.array(
        F.struct(F.lit("calibration").alias("reason"), calibration.alias("detail")),
        F.struct(F.lit("tokenizer").alias("reason"), smoke.alias("detail"))), lambda r: r["detail"].isNotNull()))
    return broken.unionByName(twice).unionByName(rows.select("runId", named.alias("r")).select("runId", "r.*")).distinct()


def score_gated(archive, runs, decisions, scorer, path, verdicts=None, secrets=(), canonical=True):
    """Score the runs that pass all gates and publish their scores under the identity of the scoring.

    The gates are ``preflight``, then that every eligible record could be judged: a run with a missing or
    malformed verdict is refused whole.  Scores are masked, published in two phases under ``path`` and never
    replaced: a run scored before by the same scorer and calibration is refused.  Returns the refused runs as
    (runId, reason, detail); read the scores with ``sources.published.published``.
    """
    refused = materialized(preflight(archive, runs, decisions, canonical), "refused")
    admitted = runs.join(refused.select("runId").distinct(), "runId", "left_anti")
    basis = decisions.select("calibrationSetId", "calibrationHash")
    named = lookup_join(admitted, basis, ["calibrationSetId"], "left", spread=["runId"]).select(
        "runId", "fixtureHash", "manifestHash", struct_digest(
            "manifestHash", "fixtureHash", F.lit(scorer.version).alias("scorerVersion"), F.lit(scorer.code_hash).alias("scorerHash"),
            F.lit(scorer.judge).alias("judge"), "calibrationHash", F.lit(canonical).alias("canonical")).alias("identity"))
    named = materialized(named, "admitted")
    known = P.identities(runs.sparkSession, path).select("identity")
    again = named.join(known, "identity", "left_semi")
    named = named.join(known, "identity", "left_anti")
    gold = lookup_join(archive.gold, named.select("runId"), ["runId"], "left_semi", spread=["probeId"])
    scores = materialized(score_runs(gold, archive.captured, named, scorer.version, verdicts, scorer.pinned_model), "scores")
    unjudged = scores.filter("eligibleForAccuracy AND goldError IS NOT NULL").groupBy("runId").agg(F.min("goldError").alias("detail"))
    fine = lookup_join(scores, unjudged.select("runId"), ["runId"], "left_anti", spread=["probeId"])
    rows = lookup_join(without_secrets(fine, secrets), named.select("runId", "identity"), ["runId"], "inner", spread=["probeId"])
    counts = gold.groupBy("runId").agg(F.count(F.lit(1)).alias("rows"))
    expected = counts.join(unjudged, "runId", "left_anti").join(named, "runId").groupBy("identity").agg(F.sum("rows").alias("rows"))
    lost = P.publish_audited(rows.drop("goldError"), path, expected)
    late = named.join(lost, "identity").select("runId", F.lit("publication").alias("reason"), F.col("reason").alias("detail"))
    return (refused.unionByName(again.select("runId", F.lit("publication").alias("reason"), F.lit("already published").alias("detail")))
            .unionByName(unjudged.select("runId", F.lit("verdict").alias("reason"), "detail")).unionByName(late))


@dataclass
class Report:
    """The parts of a report, one row per run unless said otherwise."""

    accuracy: DataFrame
    breakdown: DataFrame  # run, dimension, label
    abstention: DataFrame
    tokens: DataFrame
    relevance: DataFrame
    relevance_per_probe: DataFrame  # run, probe
    operations: DataFrame
    token_distribution: DataFrame
    request_latency: DataFrame
    probe_latency: DataFrame


def report_runs(gold, captured, scores, requests, facts_of_turns, required):
    """All metrics of many runs.

    gold: runId, fixtureId, probeId, ability, answerability, sessionDistance, evidenceCardinality;
    requests: runId, probeId, status, category, totalTokens, tierTokens, requestOverheadTokens,
    latencyMs, tierSegments; facts_of_turns: from ``metrics.turn_facts``; required: runId, probeId, factId.
    """
    # Ten aggregations read the outcomes: the join that makes them runs once.
    outcome = materialized(M.outcomes(gold, captured, scores).select(
        "runId", *M.DIMENSIONS, "answerability", "judgment", "correct", "eligible", "failureCategory",
        "latencyMs"), "outcomes")
    accuracy = M.accuracy(outcome)
    per_probe = M.relevance_per_probe(gold, M.retrieved_sources(requests), facts_of_turns, required)
    operations = (M.incomplete(outcome).join(M.failures(outcome), "runId")
                  .join(M.budget_failures(outcome, requests), "runId", "left"))
    return Report(
        accuracy=accuracy, breakdown=M.breakdown(outcome), abstention=M.abstention(outcome),
        tokens=M.token_efficiency(accuracy.select("runId", "accuracy"), M.tokens(requests)),
        relevance=M.relevance(per_probe), relevance_per_probe=per_probe, operations=operations,
        token_distribution=M.latency(requests, "totalTokens"), request_latency=M.latency(requests),
        probe_latency=M.latency(outcome))


def compare_reports(reports):
    """Curves over many published reports: points, missing scales, repeat variance and violations.

    reports: manifestHash, arrival, scale, fixtureHash, deterministic, correct, answered, total and the
    configuration fields.
    """
    points = V.curve_points(reports.withColumn("accuracy", ratio("correct", "answered"))
                            .withColumn("completionRate", ratio("answered", "total")))
    numbered = V.repeat_index(points)
    return {"points": numbered, "missingScales": V.missing_scales(points), "variance": V.repeat_variance(points),
            "accuracyLines": V.segments(numbered, "accuracy"), "completionLines": V.segments(numbered, "completionRate"),
            "violations": V.curve_violations(reports)}


def calibrate(rows, headers, score, require_human=True):
    """Run a scorer over calibration corpora and decide on it.

    rows: the columns of a calibration row; headers: calibrationSetId and provenance fields; score: a
    function from label-free rows (with the answer to judge) to rows with judgment, correct and
    matchingMethod.
    """
    keys = ["calibrationSetId", "probeId"]
    blind = C.without_labels(rows.withColumn("answer", F.col("candidateAnswer")))
    predictions = score(blind)
    agreed = C.agreements(rows, predictions, keys)
    gated = C.gate(agreed, ["calibrationSetId"])
    return {"decision": C.decision(gated, C.provenance(headers).select("calibrationSetId", "kind"), require_human),
            "mismatches": agreed.filter("NOT agrees"), "violations": C.prediction_violations(predictions, keys)}


def generate_corpus(seeds, held_out=False):
    """Fixture tables of many seeds, refused when a seed, a scale or a generated fixture is invalid."""
    wrong = G.seed_problems(seeds, held_out)
    if not wrong.isEmpty():
        raise ValueError(wrong.first().problem)
    tables = G.generate(seeds)
    assert_valid(fixture_violations(tables))
    return tables
