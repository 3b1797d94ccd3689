"""End-to-end jobs over the customer and event tables."""

from pyspark.sql import functions as F

from mnemoscope.operators import metrics as M
from mnemoscope.functions import secret_forms
from mnemoscope.plans import jobs as P
from mnemoscope.plans.catalog import query
from mnemoscope.plans.matching_queries import _CUSTOMER, _DECLINES, customer_answers
from mnemoscope.plans.metric_queries import VIEWS
from mnemoscope.session import scratch_folder
from mnemoscope.sources import published
from mnemoscope.sources import tables as T

# A nation is a run, each of its customers a probe; rich customers were never asked and poor ones
# failed on the provider.
SCORED = f"""WITH {_CUSTOMER}, s AS (SELECT c_nationkey AS "runId", "probeId", un, hit, norm, answer, c_acctbal > 9000 AS unattempted, c_acctbal BETWEEN 0 AND 500 AS failed
  FROM m JOIN (SELECT c_custkey AS "probeId", c_nationkey, c_acctbal FROM customer) USING ("probeId")),
 scored AS (SELECT *, NOT unattempted AND NOT failed AS eligible, CASE WHEN unattempted OR failed THEN 'incomplete' WHEN un THEN CASE WHEN hit THEN 'abstain' ELSE 'fail' END WHEN hit THEN 'pass'
  WHEN answer IS NOT NULL AND regexp_replace(norm, '[.!?]+$', '') IN ({_DECLINES}) THEN 'abstain' ELSE 'fail' END AS judgment FROM s) """


def scored(spark, folder):
    nation = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("probeId"), F.col("c_nationkey").alias("runId"), "c_acctbal")
    answers = customer_answers(spark, folder).join(nation, "probeId")
    gold = answers.select("runId", "probeId", "answerability", "expected")
    failed = F.col("c_acctbal").between(0, 500)
    captured = answers.filter("c_acctbal <= 9000").select(
        "runId", "probeId", F.when(~failed, F.col("answer")).alias("answer"), F.when(failed, "provider").alias("category"),
        (~failed).alias("eligibleForAccuracy"))
    runs = T.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("runId"), F.sha2("n_name", 256).alias("fixtureHash"), F.sha2(F.concat("n_name", F.lit("m")), 256).alias("manifestHash"))
    return gold, captured, P.score_runs(gold, captured, runs, "1.0.0")


@query("score_runs", SCORED + """SELECT "runId", "probeId", CASE WHEN eligible THEN CASE WHEN un THEN 'abstain' ELSE 'exact' END ELSE 'not-scored' END AS "matchingMethod", judgment,
 CASE WHEN eligible THEN hit ELSE FALSE END AS correct, eligible AS "eligibleForAccuracy", CASE WHEN unattempted THEN 'unattempted' WHEN failed THEN 'provider' END AS "failureCategory",
 sha256(n_name) AS "fixtureHash" FROM scored JOIN nation ON n_nationkey = "runId" """)
def score_runs(spark, folder):
    _, _, scores = scored(spark, folder)
    return scores.select("runId", "probeId", "matchingMethod", "judgment", "correct", "eligibleForAccuracy", "failureCategory", "fixtureHash")


@query("report_runs", SCORED + """SELECT "runId", count(*) FILTER (eligible AND hit) AS correct, count(*) FILTER (eligible) AS answered, count(*) AS total,
 CAST(count(*) FILTER (eligible AND hit) AS DOUBLE) / nullif(count(*) FILTER (eligible), 0) AS accuracy, CAST(count(*) FILTER (eligible) AS DOUBLE) / count(*) AS "completionRate",
 count(*) FILTER (failed AND NOT unattempted) AS "incompleteCount", CAST(count(*) FILTER (failed AND NOT unattempted) AS DOUBLE) / count(*) > 0.05 AS "investigationRequired",
 count(*) FILTER (eligible AND un AND judgment = 'abstain') AS "correctAbstentions", count(*) FILTER (eligible AND NOT un AND judgment = 'abstain') AS "falseAbstentions" FROM scored GROUP BY 1""")
def report_runs(spark, folder):
    gold, captured, scores = scored(spark, folder)
    outcome = M.outcomes(gold, captured.withColumn("latencyMs", F.lit(None).cast("double")), scores)
    return (M.accuracy(outcome).join(M.incomplete(outcome).select("runId", "incompleteCount", "investigationRequired"), "runId")
            .join(M.abstention(outcome).select("runId", "correctAbstentions", "falseAbstentions"), "runId"))


@query("report_operations", VIEWS + """, o AS (SELECT "runId", count(*) FILTER ("failureCategory" IN ('provider', 'adapter', 'timeout')) AS "incompleteCount", count(*) AS total,
 count(*) FILTER ("failureCategory" = 'budget') AS "overBudgetFailures", count(*) FILTER ("failureCategory" = 'unattempted') AS "unattemptedCount" FROM outcome GROUP BY 1),
 r AS (SELECT "runId", count(*) FILTER (status = 'error' AND category = 'budget') AS "budgetRequestFailures" FROM request GROUP BY 1)
 SELECT "runId", "incompleteCount", total, "overBudgetFailures", "unattemptedCount", "budgetRequestFailures" FROM o JOIN r USING ("runId")""")
def report_operations(spark, folder):
    """The operational part of a full report over the event archive, provenance included in its plan."""
    requests = T.requests(spark, folder).withColumn("tierSegments", F.array(F.struct(F.array("event_type").alias("sourceIds"))))
    gold = T.gold(spark, folder)
    required = gold.select("runId", "probeId", F.col("ability").alias("factId"))
    facts = gold.select("fixtureId", F.lit("click").alias("turnId"), F.col("ability").alias("factId")).distinct()
    report = P.report_runs(gold, T.captured(spark, folder), T.scores(spark, folder), requests, facts, required)
    return report.operations.select("runId", "incompleteCount", "total", "overBudgetFailures", "unattemptedCount", "budgetRequestFailures")


# A nation's customers are the probes of a run, half of them judged by a table of verdicts.  Runs 3, 5, 6, 8 and 11
# break a rule, are not finished, use the smoke tokenizer, rest on a calibration that failed, or lack a verdict.
GATED = """WITH lacking AS (SELECT c_nationkey FROM customer WHERE c_nationkey = 11 AND c_custkey % 4 = 0 AND c_acctbal >= 0),
 run AS (SELECT n_nationkey AS "runId" FROM nation WHERE n_nationkey NOT IN (3, 5, 6, 8) AND n_nationkey NOT IN (SELECT c_nationkey FROM lacking)),
 probe AS (SELECT c_nationkey AS "runId", c_custkey AS "probeId", c_custkey % 2 = 0 AS semantic, c_acctbal < 0 AS failed, c_acctbal < 5000 AS agrees, c_mktsegment FROM customer JOIN run ON "runId" = c_nationkey) """


def _archive(spark, folder):
    customer = T.table(spark, folder, "customer")
    semantic, failed = F.col("c_custkey") % 2 == 0, F.col("c_acctbal") < 0
    run, probe = F.col("c_nationkey").alias("runId"), F.col("c_custkey").alias("probeId")
    claims = F.array(F.col("c_mktsegment"))
    nothing = F.array().cast("array<string>")
    expected = F.struct(
        F.when(semantic, "semantic").otherwise("exact").alias("matchType"), F.array("c_mktsegment").alias("acceptedAnswers"),
        *[F.lit(None).cast("string").alias(n) for n in ("targetNumber", "tolerance", "toleranceMode")],
        F.when(semantic, claims).alias("requiredClaims"), F.when(semantic, nothing).alias("disallowedContradictions"))
    gold = customer.select(run, probe, F.lit(True).alias("answerability"), F.lit("s-1").alias("afterSessionId"), expected.alias("expected"))
    request = F.concat(F.lit("r-"), F.col("c_custkey"))
    status = F.when(failed, "error").otherwise("ok").alias("status")
    category = F.when(failed, "provider").alias("category")
    captured = customer.select(
        run, probe, F.lit("s-1").alias("sessionId"), status, category, (~failed).alias("eligibleForAccuracy"),
        F.when(~failed, F.concat(F.lower("c_mktsegment"), F.when(semantic, F.lit(" says ORDER  Key")).otherwise(F.lit("")))).alias("answer"),
        F.array(request).alias("requestIds"), F.array(F.struct(request.alias("requestId"), F.lit("h").alias("hash"))).alias("requests"))
    tokens = F.when(F.col("c_nationkey") == 3, 30000).otherwise(100).cast("bigint")
    requests = customer.select(run, probe, request.alias("requestId"), status, category, tokens.alias("totalTokens"), F.lit(0).cast("bigint").alias("requestOverheadTokens"),
                               F.struct(*[F.lit(1).cast("bigint").alias(t) for t in ("stable", "semi-stable", "unstable")]).alias("tierTokens"))
    nation = T.table(spark, folder, "nation").select(F.col("n_nationkey").alias("runId"), "n_name")
    lifecycle = nation.select("runId", F.when(F.col("runId") == 5, "running").otherwise("completed").alias("status"))
    runs = nation.select("runId", F.sha2("n_name", 256).alias("fixtureHash"), F.sha2(F.concat("n_name", F.lit("m")), 256).alias("manifestHash"),
                         F.when(F.col("runId") == 6, "characters-smoke").otherwise("cl100k").alias("tokenizer"),
                         F.when(F.col("runId") == 8, "Brand#1").otherwise("all").alias("calibrationSetId"))
    said = F.when(F.col("c_acctbal") < 5000, "pass").otherwise("fail")
    output = F.to_json(F.struct(
        said.alias("judgment"), F.array(F.col("c_acctbal") < 5000).alias("requiredClaimCoverage"), F.array().cast("array<boolean>").alias("contradictionFlags"),
        F.lit(1).alias("confidence"), F.concat(F.lit("saw \uff2frder KEY in "), F.col("c_mktsegment")).alias("reasoning")))
    verdicts = customer.filter(semantic & ~failed & ~((F.col("c_nationkey") == 11) & (F.col("c_custkey") % 4 == 0))).select(
        run, probe, output.alias("output"), F.lit("judge-1").alias("model"))
    return P.Archive(gold, captured, requests, lifecycle), runs, verdicts


def _decisions(spark, folder):
    """Calibration sets of parts: the scorer errs on a tenth of one brand and never elsewhere."""
    part = T.table(spark, folder, "part")
    sets = F.explode(F.array(F.lit("all"), F.when(F.col("p_brand") == "Brand#1", F.lit("Brand#1")))).alias("calibrationSetId")
    rows = part.select(sets, F.col("p_partkey").alias("probeId"), F.col("p_brand").alias("candidateAnswer"), F.lit("pass").alias("goldJudgment")).filter("calibrationSetId IS NOT NULL")
    headers = rows.select("calibrationSetId").distinct().select(
        "calibrationSetId", F.lit("-").alias("rowsHash"), F.lit("manual").alias("labelingMethod"), F.lit("manual").alias("reviewMethod"),
        F.lit("human").alias("labelKind"), F.lit("a").alias("labelerId"), F.lit("human").alias("reviewKind"), F.lit("b").alias("reviewerId"))

    def score(blind):
        wrong = (F.col("calibrationSetId") != "all") & (F.col("probeId") % 2 == 0)
        return blind.withColumns({"judgment": F.when(wrong, "fail").otherwise("pass"), "correct": ~wrong, "matchingMethod": F.lit("exact")})
    return P.calibrate(rows, headers, score)["decision"].withColumn("calibrationHash", F.sha2("calibrationSetId", 256))


def _gated(spark, folder):
    archive, runs, verdicts = _archive(spark, folder)
    path = scratch_folder(spark, "scores")
    scorer = P.Scorer("1.0.0", "code", "judge", "judge-1")
    given = (archive, runs, _decisions(spark, folder), scorer, path, verdicts, ("order key",))
    return P.score_gated(*given), path, given


@query("job_score_gated", GATED + """SELECT "runId", "probeId", CASE WHEN failed THEN 'incomplete' WHEN semantic AND NOT agrees THEN 'fail' ELSE 'pass' END AS judgment, CASE WHEN failed THEN 'not-scored' WHEN semantic THEN 'semantic' ELSE 'exact' END AS "matchingMethod",
 NOT failed AND (NOT semantic OR agrees) AS correct, CASE WHEN NOT failed THEN lower(c_mktsegment) || CASE WHEN semantic THEN ' says [REDACTED]' ELSE '' END END AS "rawAnswer",
 CASE WHEN NOT failed THEN lower(c_mktsegment) || CASE WHEN semantic THEN ' says [REDACTED]' ELSE '' END END AS "normalizedAnswer",
 CASE WHEN semantic AND NOT failed THEN 'saw [REDACTED] in ' || c_mktsegment END AS reasoning FROM probe""")
def job_gated(spark, folder):
    """Published scores, read back: runs with a fault are absent, secrets are masked in every written form."""
    _, path, _ = _gated(spark, folder)
    return published.published(spark, path).select(
        "runId", "probeId", "judgment", "matchingMethod", "correct", "rawAnswer", "normalizedAnswer", F.get_json_object("judgeOutput", "$.reasoning").alias("reasoning"))


@query("job_score_refused", GATED + """SELECT n_nationkey AS "runId", CASE WHEN n_nationkey IN (SELECT c_nationkey FROM lacking) THEN 'verdict' ELSE CASE n_nationkey WHEN 3 THEN 'R01' WHEN 5 THEN 'R16' WHEN 6 THEN 'tokenizer' WHEN 8 THEN 'calibration' ELSE 'publication' END END AS reason
 FROM nation WHERE n_nationkey IN (5, 6, 8) OR n_nationkey IN (SELECT c_nationkey FROM customer)""")
def job_refused(spark, folder):
    """What a second scoring of the same runs refuses: the faults, and all that the first one published."""
    _, _, given = _gated(spark, folder)
    return P.score_gated(*given).select("runId", "reason")


@query("f17_secret_forms", """SELECT event_id, 'got [REDACTED], ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' and [REDACTED]' ELSE '' END AS text FROM events""")
def f17_forms(spark, folder):
    """Every event's message echoes a key: as it is, in capitals, in wide letters, or with other blanks; two keys overlap in a third of them."""
    form = F.element_at(F.array(*[F.lit(x) for x in ("my secret key", "MY Secret KEY", "\uff4d\uff59 secret key", "my\t secret\nkey")]), (F.col("event_id") % 4 + 1).cast("int"))
    second = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" and "), form, F.lit("board"))).otherwise(F.lit(""))
    text = F.concat(F.lit("got "), form, F.lit(", "), "event_type", second)
    return T.table(spark, folder, "events").select("event_id", secret_forms.mask_forms(text, ("my secret key", "keyboard")).alias("text"))
