"""Rules R (run archives), K (scores) and C (calibration corpora), over tables of many runs."""

from pyspark.sql import functions as F

from mnemoscope.functions import jsontype as J
from mnemoscope.functions.number import is_number
from mnemoscope.functions.ratio import holds
from mnemoscope.functions.text import blank, zoned_timestamp
from mnemoscope.functions.tokens import TOKEN_BUDGET
from mnemoscope.operators.archive import duplicates, linked_requests
from mnemoscope.operators.calibration import review_problems, strata
from mnemoscope.operators.joins import lookup_join
from mnemoscope.operators.matching import JUDGMENTS, MATCH_TYPES, semantic_correct
from mnemoscope.operators.metrics import CATEGORIES, TIERS
from mnemoscope.quality.framework import all_of, flag, found
from mnemoscope.sources.tables import ABILITIES

KEY = ["runId", "probeId"]


def archive_violations(requests, captured, gold, lifecycle, identities=None):
    """Requests and captured probes of finished runs.

    requests: runId, requestId, probeId, status, category, totalTokens, tierTokens,
    requestOverheadTokens and, where requests were counted again, retokenized (the same three as a
    struct); captured: runId, probeId, sessionId, status, category, eligibleForAccuracy, answer,
    requestIds, requests (array of requestId and hash); gold: runId, probeId, afterSessionId;
    lifecycle: runId, status; identities: from ``archive.compact_identity``.
    """
    over = F.col("totalTokens") > TOKEN_BUDGET
    rejected = (F.col("status") == "error") & (F.col("category") == "budget")
    tiers_ok = F.lit(True)
    for tier in TIERS:
        tiers_ok = tiers_ok & (F.col(f"tierTokens.`{tier}`") >= 0)
    rules = [
        ("R01", ~over | rejected, "a request above the budget went through"),
        ("R03", F.col("status").isin("ok", "error"), "request status is neither ok nor error"),
        ("R04", ~blank(F.col("requestId")), "requestId required"),
        ("R06", (F.col("totalTokens") >= 0) & (F.col("requestOverheadTokens") >= 0) & tiers_ok,
         "token counts must be nonnegative integers"),
    ]
    if "retokenized" in requests.columns:
        same = F.col("retokenized") == F.struct("totalTokens", "tierTokens", "requestOverheadTokens")
        rules.append(("R02", same, "counting the tokens again gives another result"))
    calls = flag(requests, "runId", F.coalesce("requestId", F.lit("request")), rules)
    twice = duplicates(requests, ["runId", "requestId"])
    parts = [calls, found(twice, "runId", F.col("requestId"), "R05", "a request id occurs twice in its run")]

    where = gold.select(*KEY, F.col("afterSessionId").alias("_checkpoint"), F.lit(True).alias("_gold"))
    rows = captured.join(where, KEY, "left")
    eligible = F.col("eligibleForAccuracy")
    linked_ids = F.transform("requests", lambda r: r["requestId"])
    parts.append(flag(rows, "runId", F.coalesce("probeId", F.lit("probe")), [
        ("R07", F.col("_gold").isNotNull(), "unknown captured probe"),
        ("R08", F.col("_gold").isNull() | (F.col("sessionId") == F.col("_checkpoint")), "captured at another checkpoint"),
        ("R09", eligible.isNotNull() & (F.col("status") == F.when(eligible, "ok").otherwise("error")),
         "status and eligibility disagree"),
        ("R10", ~holds(eligible) | F.col("answer").isNotNull(), "an answered probe has no answer"),
        ("R11", holds(eligible) | F.col("category").isin(*CATEGORIES), "a failed probe has no known category"),
        ("R12", F.col("requests").isNotNull() & (~holds(eligible) | (F.size("requests") > 0)), "the probe carries no requests"),
        ("R14", F.col("requestIds") == linked_ids, "request ids differ from the carried requests"),
    ]))
    parts.append(found(duplicates(captured, KEY), "runId", F.col("probeId"), "R07", "duplicate captured probe"))
    completed = gold.join(lifecycle.filter("status = 'completed'").select("runId"), "runId", "left_semi")
    parts.append(found(completed.join(captured, KEY, "left_anti"), "runId", F.col("probeId"), "R15",
                       "a completed run lacks a probe"))
    open_runs = lifecycle.filter(~holds(F.col("status").isin("completed", "terminated")))
    parts.append(found(open_runs, "runId", F.lit("manifest"), "R16", "the run has no final status"))
    foreign = requests.filter("probeId IS NOT NULL").join(captured, KEY, "left_anti")
    parts.append(found(foreign, "runId", F.col("requestId"), "R17", "the request's probe was not captured"))
    if identities is not None:
        links = linked_requests(captured, identities).filter("problem IS NOT NULL")
        parts.append(links.select(F.lit("R18").alias("ruleId"), F.col("runId").alias("scope"),
                                  F.concat_ws(":", "probeId", "requestId").alias("path"), F.col("problem").alias("detail")))
    return all_of(parts)


def score_violations(scores, gold, captured, manifests):
    """Scores against their gold records, their captured probes and their run.

    scores: schemas.SCORE; gold: runId, probeId, matchType, answerability; captured: runId, probeId,
    eligibleForAccuracy, answer, category; manifests: runId, fixtureHash, manifestHash, scorerVersion.
    """
    source = captured.select(*KEY, F.struct("eligibleForAccuracy", "answer", "category").alias("c"))
    record = gold.select(*KEY, F.struct("matchType", "answerability").alias("g"))
    run = manifests.select("runId", F.struct("fixtureHash", "manifestHash", "scorerVersion").alias("m"))
    rows = lookup_join(scores.join(record, KEY, "left").join(source, KEY, "left"), run, ["runId"], "left", spread=["probeId"])
    eligible = F.coalesce("c.eligibleForAccuracy", F.lit(False))
    judgment, method = F.col("judgment"), F.col("matchingMethod")
    semantic = F.col("g.matchType") == "semantic"
    right = F.when(semantic, semantic_correct(judgment, F.col("g.answerability"))).otherwise(
        (judgment == "pass") | ((F.col("g.matchType") == "abstain") & (judgment == "abstain") & ~F.col("g.answerability")))
    category = F.when(F.col("c").isNull(), "unattempted").otherwise(F.col("c.category"))
    known = F.col("g").isNotNull()
    parts = [flag(rows, "runId", F.coalesce("probeId", F.lit("score")), [
        ("K01", known, "no gold record for the score"),
        ("K02", (F.col("fixtureHash") == F.col("m.fixtureHash")) & (F.col("manifestHash") == F.col("m.manifestHash"))
         & (F.col("scorerVersion") == F.col("m.scorerVersion")), "fixture, manifest or scorer differ from the run's"),
        ("K03", F.col("eligibleForAccuracy") == eligible, "eligibility differs from the captured probe"),
        ("K04", F.col("rawAnswer").eqNullSafe(F.col("c.answer")), "answer differs from the captured probe"),
        ("K05", F.col("failureCategory").eqNullSafe(category), "failure category differs from the captured probe"),
        ("K06", F.col("correct").isNotNull(), "correctness is missing"),
        ("K07", eligible | ((method == "not-scored") & (judgment == "incomplete") & ~F.col("correct")
                            & F.col("normalizedAnswer").isNull() & F.col("judgeOutput").isNull()),
         "an unanswered probe carries a judgment"),
        ("K08", ~eligible | ((method == F.col("g.matchType")) & judgment.isin(*JUDGMENTS)), "method or judgment outside its domain"),
        ("K09", ~eligible | (F.col("judgeOutput").isNotNull() == holds(semantic)), "judge output belongs to semantic scores only"),
        ("K10", ~eligible | (F.col("correct") == right), "correctness does not follow from the judgment"),
    ])]
    parts.append(found(duplicates(scores, KEY), "runId", F.col("probeId"), "K01", "a probe is scored twice"))
    parts.append(found(gold.join(scores, KEY, "left_anti"), "runId", F.col("probeId"), "K11", "a gold probe has no score"))
    return all_of(parts)


def calibration_violations(rows, reviews, headers):
    """Calibration corpora: headers, rows, strata and reviews.

    rows: calibrationSetId, probeId, ability, question, candidateAnswer, expected, goldJudgment,
    justification, answerability, answerAsOf, afterSessionIndex, edgeCases, evidence; reviews:
    calibrationSetId, probeId, confirmedGoldJudgment, justificationConsistent, evidenceConsistent,
    reviewNote; headers: calibrationSetId and the header fields of manifest, probes and review, with
    declared and computed file hashes.
    """
    def text(*names):
        condition = F.lit(True)
        for name in names:
            condition = condition & ~blank(F.col(name))
        return condition
    parts = [flag(headers, "calibrationSetId", F.lit("header"), [
        ("C01", (F.col("manifestSchemaVersion") == "calibration-manifest-1.0") & (F.col("schemaVersion") == "calibration-1.0")
         & F.col("frozen"), "version unknown or corpus not frozen"),
        ("C02", (F.col("manifestSetId") == F.col("calibrationSetId")) & (F.col("reviewSetId") == F.col("calibrationSetId"))
         & (F.col("manifestSetVersion") == F.col("calibrationSetVersion")), "set identity must agree"),
        ("C03", text("retainedWithScorerVersion", "frozenAt", "labelingMethod", "reviewMethod", "reviewedAt"), "header texts required"),
        ("C04", F.col("requiredAgreement") == 0.95, "gate requires 95% agreement"),
        ("C05", (F.col("declaredProbesHash") == F.col("probesHash")) & (F.col("declaredReviewHash") == F.col("reviewHash"))
         & (F.col("reviewProbesHash") == F.col("probesHash")), "frozen SHA-256 hash mismatch"),
        ("C06", F.col("result") == "passed", "the review did not pass"),
    ])]
    balance = strata(rows.withColumn("matchType", F.col("expected.matchType")))
    parts.append(flag(balance, "calibrationSetId", F.lit("strata"), [
        ("C07", F.col("sizeOk"), "require 90..110 rows"),
        ("C08", F.col("abilitiesOk"), "fewer than ten rows of an ability"),
        ("C09", F.col("matchTypesOk"), "a match type is missing"),
        ("C10", F.col("semanticOk"), "fewer than 30 % semantic rows"),
    ]))
    parts.append(found(duplicates(rows, ["calibrationSetId", "probeId"]), "calibrationSetId", F.col("probeId"), "C11", "duplicate probe id"))

    required, forbidden = F.col("expected.requiredFactIds"), F.col("expected.forbiddenFactIds")
    ids = F.transform("evidence", lambda e: e["factId"])
    kind = F.col("expected.matchType")
    answers = F.col("expected.acceptedAnswers")
    stale = F.filter("evidence", lambda e: F.array_contains(required, e["factId"]) & (e["state"] != "active"))
    lists = F.forall(answers, lambda a: holds(F.from_json(a, "array<string>") == F.col("expected.items"))
                     & holds(F.forall(J.element_schemas(a), lambda s: s == "STRING")))
    parts.append(flag(rows, "calibrationSetId", F.coalesce("probeId", F.lit("row")), [
        ("C12", text("probeId", "question", "candidateAnswer", "justification"), "texts required"),
        ("C13", F.col("ability").isin(*ABILITIES) & F.col("goldJudgment").isin(*JUDGMENTS)
         & F.col("answerAsOf").isin("current", "historical") & F.col("answerability").isNotNull()
         & kind.isin(*MATCH_TYPES), "value outside its domain"),
        ("C14", F.col("afterSessionIndex") >= 1, "afterSessionIndex: expected a positive integer"),
        ("C15", F.forall("edgeCases", lambda t: ~blank(t)), "edgeCases: expected nonempty strings"),
        ("C16", F.forall("evidence", lambda e: ~blank(e["factId"]) & ~blank(e["text"])
                         & e["state"].isin("active", "superseded", "expired")
                         & (e["sessionIndex"] > 0) & (e["sessionIndex"] < F.col("afterSessionIndex"))),
         "evidence must be well formed and precede the probe"),
        ("C17", F.size(F.array_distinct(ids)) == F.size(ids), "evidence: duplicate fact id"),
        ("C18", (F.size(answers) > 0) & F.forall(answers, lambda a: ~blank(a)), "acceptedAnswers: nonempty list"),
        ("C19", (F.size(F.array_except(required, ids)) == 0) & (F.size(F.array_except(forbidden, ids)) == 0)
         & (F.size(F.array_distinct(required)) == F.size(required)) & (F.size(F.array_distinct(forbidden)) == F.size(forbidden)),
         "unknown or duplicate evidence ids"),
        ("C20", ~F.arrays_overlap(required, forbidden), "required and forbidden facts overlap"),
        ("C21", (F.col("answerAsOf") != "current") | (F.size(stale) == 0), "a current answer rests on a fact that ended"),
        ("C22", (kind != "semantic") | (~blank(F.col("expected.rubric")) & (F.size("expected.requiredClaims") > 0)
                                        & F.col("expected.disallowedContradictions").isNotNull()), "semantic: rubric and claims required"),
        ("C23", (kind != "numeric") | ((F.col("expected.toleranceMode") == "absolute-inclusive")
                                       & is_number(F.col("expected.targetNumber")) & is_number(F.col("expected.tolerance"))
                                       & ~F.col("expected.tolerance").rlike("^-.*[1-9]")), "numeric: finite target and tolerance required"),
        ("C24", (kind != "ordered-list") | ((F.size("expected.items") > 0) & lists), "ordered-list: answers must agree with items"),
        ("C25", (kind != "abstain") | (~F.col("answerability") & (F.size(required) == 0) & (F.size(forbidden) == 0)),
         "abstain records must be unanswerable"),
    ]))
    problems = review_problems(rows, reviews)
    parts.append(problems.select(F.lit("C26").alias("ruleId"), F.col("calibrationSetId").alias("scope"),
                                 F.col("probeId").cast("string").alias("path"), F.col("problem").alias("detail")))
    parts.append(found(duplicates(reviews, ["calibrationSetId", "probeId"]), "calibrationSetId", F.col("probeId"), "C27", "duplicate review id"))
    return all_of(parts)


def event_violations(events):
    """Events of a run log: every event has a known type and a timestamp with its zone."""
    # Event types.
    types = ("run_started", "session_started", "turn", "probe", "session_completed", "session_terminated",
             "run_completed", "run_terminated", "interruption", "resume", "resume_restart")
    return flag(events, "runId", F.col("position"), [
        ("R19", F.col("type").isin(*types), "unknown event type"),
        ("R20", zoned_timestamp(F.col("timestamp")).isNotNull(), "event timestamp must name its zone"),
    ])
