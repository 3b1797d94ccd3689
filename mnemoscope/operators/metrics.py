"""Accuracy, completion, abstention, token, relevance and operational metrics of many runs at once.

Accuracy divides by answered probes, completion by all probes.  Zero denominators give NULL.
"""

from pyspark.sql import functions as F

from mnemoscope.functions.ratio import count_where, ratio
from mnemoscope.operators.joins import lookup_join
from mnemoscope.operators.quantiles import distribution

# Failure categories, token tiers and the share of incomplete probes that asks for an
# investigation.
CATEGORIES = ("budget", "provider", "adapter", "timeout")
INCOMPLETE = ("provider", "adapter", "timeout")
TIERS = ("stable", "semi-stable", "unstable")
INVESTIGATE_ABOVE = 0.05
DIMENSIONS = ("ability", "sessionDistance", "evidenceCardinality", "fixtureId")

KEY = ["runId", "probeId"]


def outcomes(gold, captured, scores):
    """One row per gold probe: was it attempted, answered, how was it judged.

    The three tables share the unique key (runId, probeId), so a hot run spreads over all tasks.
    """
    attempt = captured.select(*KEY, F.lit(True).alias("attempted"), "category", "latencyMs",
                              F.col("eligibleForAccuracy").alias("_eligible"))
    judged = scores.select(*KEY, "judgment", "correct")
    return (gold.join(attempt, KEY, "left").join(judged, KEY, "left")
            .withColumn("attempted", F.coalesce("attempted", F.lit(False)))
            .withColumn("eligible", F.coalesce("_eligible", F.lit(False)))
            .withColumn("failureCategory", F.when(~F.col("attempted"), "unattempted")
                        .when(~F.col("eligible"), F.col("category")))
            .withColumn("correct", F.coalesce("correct", F.lit(False)))
            .drop("_eligible"))


def _counts():
    return [F.sum(F.col("correct").cast("bigint")).alias("correct"),
            F.sum(F.col("eligible").cast("bigint")).alias("answered"),
            F.count(F.lit(1)).alias("total")]


def accuracy(outcome, keys=("runId",)):
    """correct, answered, total, accuracy, completionRate per group."""
    return (outcome.groupBy(*keys).agg(*_counts())
            .withColumn("accuracy", ratio("correct", "answered"))
            .withColumn("completionRate", ratio("answered", "total")))


def breakdown(outcome):
    """The accuracy block along four independent dimensions, unattempted probes included.

    One pass by grouping sets: partial counts are shuffled once, whatever the number of dimensions.
    """
    dimensions = list(DIMENSIONS)
    labels = outcome.select("runId", "correct", "eligible",
                            *[F.col(d).cast("string").alias(d) for d in dimensions])
    grouped = labels.groupingSets([["runId", d] for d in dimensions], "runId", *dimensions).agg(
        *_counts(), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    dimension = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dimensions])
    label = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in dimensions])
    return grouped.select(
        "runId", dimension.alias("dimension"), label.alias("label"), "correct", "answered", "total",
        ratio("correct", "answered").alias("accuracy"),
        ratio("answered", "total").alias("completionRate"))


def in_label_order(rows):
    """Breakdown rows for presentation: labels sort as text, so 10 comes before 9."""
    return rows.orderBy("runId", "dimension", "label")


def abstention(outcome, keys=("runId",)):
    """Abstentions among answered probes; abstaining is a judgment, not a correctness."""
    answered = F.col("eligible")
    answerable = answered & F.coalesce("answerability", F.lit(True))
    unanswerable = answered & ~F.coalesce("answerability", F.lit(True))
    abstains = F.col("judgment") == "abstain"
    counts = outcome.groupBy(*keys).agg(
        count_where(unanswerable).alias("unanswerableAnswered"),
        count_where(answerable).alias("answerableAnswered"),
        count_where(unanswerable & abstains).alias("unanswerableAbstentions"),
        count_where(unanswerable & abstains & F.col("correct")).alias("correctAbstentions"),
        count_where(unanswerable & ~abstains).alias("unsupportedAnswers"),
        count_where(answerable & abstains).alias("falseAbstentions"))
    return (counts
            .withColumn("correctAbstentionRate", ratio("correctAbstentions", "unanswerableAnswered"))
            .withColumn("unsupportedAnswerRate", ratio("unsupportedAnswers", "unanswerableAnswered"))
            .withColumn("falseAbstentionRate", ratio("falseAbstentions", "answerableAnswered")))


def failures(outcome, keys=("runId",)):
    """Failed probes per category, every category present even at 0."""
    return outcome.groupBy(*keys).agg(
        *[count_where(F.col("failureCategory") == c).alias(c) for c in CATEGORIES],
        count_where(F.col("failureCategory") == "unattempted").alias("unattemptedCount"))


def incomplete(outcome, keys=("runId",)):
    """Provider, adapter and timeout failures over all probes; strictly above 5 % asks for a look."""
    return (outcome.groupBy(*keys).agg(
        count_where(F.col("failureCategory").isin(*INCOMPLETE)).alias("incompleteCount"),
        F.count(F.lit(1)).alias("total"))
        .withColumn("incompleteProbeRate", ratio("incompleteCount", "total"))
        .withColumn("investigationRequired",
                    F.coalesce(F.col("incompleteProbeRate") > INVESTIGATE_ABOVE, F.lit(False))))


def tokens(requests, keys=("runId",)):
    """Token sums per tier, overhead and total over all requests; shares leave the overhead out."""
    tier = {t: f"tierTokens.`{t}`" for t in TIERS}
    sums = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requestCount"),
        F.sum("totalTokens").alias("totalInputTokens"),
        *[F.sum(path).alias(name.replace("-", "_")) for name, path in tier.items()],
        F.sum("requestOverheadTokens").alias("requestOverheadTokens"))
    whole = F.col("stable") + F.col("semi_stable") + F.col("unstable")
    return sums.withColumns({f"{t}_share": ratio(F.col(t), whole)
                             for t in ("stable", "semi_stable", "unstable")})


def token_efficiency(accuracies, token_sums):
    """Accuracy per 1000 input tokens: accuracy / mean tokens per request * 1000."""
    joined = accuracies.join(token_sums, "runId", "left")
    mean = F.try_divide(F.col("accuracy") * F.col("requestCount"),
                        F.col("totalInputTokens").cast("double"))
    return joined.withColumn("accuracyPer1000InputTokens", mean * 1000)


def budget_failures(outcome, requests):
    """Probes that failed on the budget, and requests that did: two different counts."""
    probes = outcome.groupBy("runId").agg(
        count_where(F.col("failureCategory") == "budget").alias("overBudgetFailures"))
    calls = requests.groupBy("runId").agg(
        count_where((F.col("status") == "error") & (F.col("category") == "budget"))
        .alias("budgetRequestFailures"))
    zero = F.lit(0).cast("bigint")
    return (probes.join(calls, "runId", "full")
            .select("runId", F.coalesce("overBudgetFailures", zero).alias("overBudgetFailures"),
                    F.coalesce("budgetRequestFailures", zero).alias("budgetRequestFailures")))


def latency(rows, value="latencyMs"):
    """Latency distribution per run over rows that report a finite one of at least zero; ``latency_violations``
    names the others."""
    possible = F.col(value).cast("double") >= 0
    return distribution(rows.withColumn(value, F.when(possible, F.col(value))), ["runId"], value)


def latency_violations(rows, keys, value="latencyMs"):
    """Rows whose latency is NaN, infinite or negative, with the problem."""
    number = F.col(value).cast("double")
    problem = (F.when(F.isnan(number) | (F.abs(number) == float("inf")), "latency: finite number required")
               .when(number < 0, "latency: must not be negative"))
    return rows.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def run_summary(outcome, requests, lifecycle):
    """The counters a finished run records about itself.

    Completion of a run without probes is 1 here, unlike the report's NULL.
    """
    per_run = outcome.groupBy("runId").agg(
        F.count(F.lit(1)).alias("totalCount"),
        count_where(F.col("eligible")).alias("answeredCount"),
        count_where(F.col("failureCategory").isin(*INCOMPLETE)).alias("incompleteCount"),
        *[count_where(F.col("failureCategory") == c).alias(f"{c}Count") for c in CATEGORIES],
        count_where(~F.col("attempted")).alias("unattemptedCount"))
    calls = requests.groupBy("runId").agg(F.count(F.lit(1)).alias("requestCount"))
    zero = F.lit(0).cast("bigint")
    counted = ("totalCount", "answeredCount", "incompleteCount", "unattemptedCount", "requestCount",
               *[f"{c}Count" for c in CATEGORIES])
    return (lifecycle.select("runId", "status").join(per_run, "runId", "left").join(calls, "runId", "left")
            .withColumns({c: F.coalesce(c, zero) for c in counted})
            .withColumn("accuracyDenominator", F.col("answeredCount"))
            .withColumn("completionRate",
                        F.coalesce(ratio("answeredCount", "totalCount"), F.lit(1.0)))
            .withColumn("investigationRequired", F.coalesce(
                ratio("incompleteCount", "totalCount") > INVESTIGATE_ABOVE, F.lit(False))))


def retrieved_sources(requests):
    """(runId, probeId, sourceId): what each probe's requests report to have retrieved.

    A probe that reports an empty list keeps one row with a NULL source; one that reports nothing
    has no row.
    """
    segments = (requests.filter("probeId IS NOT NULL")
                .select(*KEY, F.explode("tierSegments").alias("s")).filter("s.sourceIds IS NOT NULL"))
    return segments.select(*KEY, F.explode_outer("s.sourceIds").alias("sourceId")).distinct()


def turn_facts(turns, facts):
    """(fixtureId, turnId, factId): facts a turn introduces or references, by annotation or ledger."""
    annotated = turns.select("fixtureId", "turnId", F.explode(F.concat(
        F.coalesce("introducedFactIds", F.array().cast("array<string>")),
        F.coalesce("referencedFactIds", F.array().cast("array<string>")))).alias("factId"))
    ledger = facts.select("fixtureId", F.col("introducedAt").alias("turnId"), "factId")
    return annotated.unionByName(ledger).distinct()


def relevance_per_probe(gold, sources, facts_of_turns, required):
    """Retrieval precision and recall of each gold probe.

    gold: runId, fixtureId, probeId; sources: from ``retrieved_sources``; required: runId, probeId,
    factId.  A source that is a turn stands for its facts; unknown sources and turns without facts
    stay as themselves and count as wrong.
    """
    with_fixture = sources.join(gold.select(*KEY, "fixtureId"), KEY)
    # One turn may be retrieved by a third of all probes: spread its rows by probe.
    named = lookup_join(with_fixture, facts_of_turns.withColumnRenamed("turnId", "sourceId"),
                        ["fixtureId", "sourceId"], "left", spread=["runId", "probeId"])
    evidence = named.select(*KEY, F.coalesce("factId", "sourceId").alias("factId")).distinct()
    needed = required.select(*KEY, "factId").distinct()
    marked = evidence.join(needed.withColumn("_needed", F.lit(1)), [*KEY, "factId"], "left")
    found = marked.groupBy(*KEY).agg(F.count("factId").alias("retrievedCount"),
                                     F.count("_needed").alias("matchedCount"))
    wanted = needed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("requiredCount"))
    rows = gold.select(*KEY).join(found, KEY, "left").join(wanted, KEY, "left")
    rows = rows.withColumn("requiredCount", F.coalesce("requiredCount", F.lit(0).cast("bigint")))
    reported = F.col("retrievedCount").isNotNull()
    precision = (F.when(reported & (F.col("retrievedCount") > 0), ratio("matchedCount", "retrievedCount"))
                 .when(reported & (F.col("requiredCount") > 0), F.lit(0.0)))
    return rows.select(
        *KEY, F.when(reported, "reported").otherwise("not-reported").alias("status"),
        "retrievedCount", "requiredCount", "matchedCount", precision.alias("precision"),
        F.when(reported, ratio("matchedCount", "requiredCount")).alias("recall"))


def relevance(per_probe):
    """Macro means over probes with defined values; a run's own mean needs provenance of all probes."""
    rows = per_probe.groupBy("runId").agg(
        count_where(F.col("status") == "reported").alias("reportedCount"),
        count_where(F.col("status") != "reported").alias("notReportedCount"),
        F.avg("precision").alias("reportedPrecision"), F.avg("recall").alias("reportedRecall"),
        F.count("precision").alias("precisionDefinedCount"),
        F.count("recall").alias("recallDefinedCount"))
    complete = F.col("notReportedCount") == 0
    return rows.select(
        "runId", F.when(F.col("reportedCount") == 0, "not-reported")
        .when(complete, "reported").otherwise("partial").alias("status"),
        "reportedCount", "notReportedCount",
        F.when(complete, F.col("reportedPrecision")).alias("precision"),
        F.when(complete, F.col("reportedRecall")).alias("recall"),
        "reportedPrecision", "reportedRecall", "precisionDefinedCount", "recallDefinedCount")


def session_distance(probes, required, facts, turns):
    """Sessions between a probe's checkpoint and its earliest required fact.

    A labelled distance wins; without evidence it is 0; evidence later than the checkpoint gives NULL.
    probes: fixtureId, probeId, checkpoint (session index), sessionDistance?; required: fixtureId,
    probeId, factId; facts: fixtureId, factId, introducedAt; turns: fixtureId, turnId, sessionIndex.
    """
    intro = facts.join(turns.select("fixtureId", F.col("turnId").alias("introducedAt"), "sessionIndex"),
                       ["fixtureId", "introducedAt"]).select("fixtureId", "factId", "sessionIndex")
    # A fact may be evidence of very many probes.
    found = lookup_join(required, intro, ["fixtureId", "factId"], "left", spread=["probeId"])
    per_probe = found.groupBy("fixtureId", "probeId").agg(
        F.min("sessionIndex").alias("_first"), F.max("sessionIndex").alias("_last"),
        F.count_if(F.col("sessionIndex").isNull()).alias("_unknown"))
    rows = probes.join(per_probe, ["fixtureId", "probeId"], "left")
    derived = (F.when(F.col("_unknown").isNull(), F.lit(0))
               .when((F.col("_unknown") == 0) & (F.col("_last") <= F.col("checkpoint")),
                     F.col("checkpoint") - F.col("_first")))
    return rows.withColumn("derivedDistance", derived.cast("int")).withColumn(
        "distance", F.coalesce(F.col("sessionDistance"), F.col("derivedDistance"))
    ).select("fixtureId", "probeId", "derivedDistance", "distance")
