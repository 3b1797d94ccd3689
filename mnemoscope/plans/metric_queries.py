"""Metric queries over the event warehouse (section 2.4 of the inventory)."""

from pyspark.sql import functions as F

from mnemoscope.operators import metrics as M
from mnemoscope.plans.catalog import query
from mnemoscope.sources import tables as T

# The derived views in SQL, for the checks only.
VIEWS = """
WITH request AS (
 SELECT event_id AS seq, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type, value,
  'run-' || user_id AS "runId", 'fx-' || (user_id // 10) AS "fixtureId", 'r-' || event_id AS "requestId",
  CASE WHEN event_type <> 'view' THEN 'p-' || event_id END AS "probeId",
  CASE WHEN event_type = 'view' THEN 't-' || event_id END AS "turnId",
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN CASE
   WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 25 THEN 'budget'
   WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 50 THEN 'provider'
   WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 75 THEN 'adapter' ELSE 'timeout' END END AS category,
  value * 2 AS "latencyMs", CAST(floor(value * 100) AS BIGINT) + 12 AS "totalTokens",
  CAST(floor(value * 100) AS BIGINT) // 4 AS stable, CAST(floor(value * 100) AS BIGINT) // 3 AS semi_stable,
  CAST(floor(value * 100) AS BIGINT) // 5 AS unstable
 FROM events),
gold AS (
 SELECT "runId", "fixtureId", "probeId", seq, ts, k, event_type, value,
  CASE hour(ts) // 5 WHEN 0 THEN 'information-extraction' WHEN 1 THEN 'cross-session-reasoning'
   WHEN 2 THEN 'temporal-reasoning' WHEN 3 THEN 'knowledge-update' ELSE 'abstention' END AS ability,
  hour(ts) // 5 < 4 AS answerability, day(ts) AS "sessionDistance",
  CASE WHEN hour(ts) // 5 = 4 THEN 0 WHEN value < 20 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS "evidenceCardinality"
 FROM request WHERE "probeId" IS NOT NULL),
captured AS (
 SELECT "runId", "probeId", seq, status, category, "latencyMs", "requestId", status = 'ok' AS "eligibleForAccuracy",
  CASE WHEN status = 'ok' THEN 'answer ' || k END AS answer
 FROM request WHERE "probeId" IS NOT NULL AND NOT (event_type = 'signup' AND value < 5)),
score0 AS (
 SELECT *, CASE WHEN event_type = 'error' OR (event_type = 'signup' AND value < 5) THEN 'incomplete'
  WHEN k < 10 THEN 'abstain' WHEN k < 70 THEN 'pass' ELSE 'fail' END AS judgment FROM gold),
score AS (
 SELECT "runId", "probeId", judgment,
  (judgment = 'pass' AND answerability) OR (judgment = 'abstain' AND NOT answerability) AS correct,
  judgment <> 'incomplete' AS "eligibleForAccuracy" FROM score0),
outcome AS (
 SELECT g.*, c."probeId" IS NOT NULL AS attempted, coalesce(c."eligibleForAccuracy", FALSE) AS eligible,
  CASE WHEN c."probeId" IS NULL THEN 'unattempted' WHEN NOT c."eligibleForAccuracy" THEN c.category END AS "failureCategory",
  c."latencyMs", s.judgment, s.correct
 FROM gold g LEFT JOIN captured c USING ("runId", "probeId") LEFT JOIN score s USING ("runId", "probeId"))
"""

_BLOCK = """CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(eligible AS INT)) AS BIGINT) AS answered, count(*) AS total,
 CAST(sum(CAST(correct AS INT)) AS DOUBLE) / nullif(sum(CAST(eligible AS INT)), 0) AS accuracy,
 CAST(sum(CAST(eligible AS INT)) AS DOUBLE) / nullif(count(*), 0) AS "completionRate" """


def outcomes(spark, folder):
    return M.outcomes(T.gold(spark, folder), T.captured(spark, folder), T.scores(spark, folder))


@query("j01_outcomes", VIEWS + """SELECT "runId", "probeId", attempted, eligible, "failureCategory", judgment, correct FROM outcome""")
def j01(spark, folder):
    return outcomes(spark, folder).select("runId", "probeId", "attempted", "eligible", "failureCategory",
                                          "judgment", "correct")


@query("a01_accuracy", VIEWS + f'SELECT "runId", {_BLOCK} FROM outcome GROUP BY "runId"')
def a01(spark, folder):
    return M.accuracy(outcomes(spark, folder))


@query("a02_breakdown", VIEWS + " UNION ALL ".join(
    f"""SELECT "runId", '{d}' AS dimension, CAST("{d}" AS VARCHAR) AS label, {_BLOCK} FROM outcome GROUP BY "runId", "{d}" """
    for d in ("ability", "sessionDistance", "evidenceCardinality", "fixtureId")))
def a02(spark, folder):
    return M.breakdown(outcomes(spark, folder))


_UN = "eligible AND NOT answerability"
_AN = "eligible AND answerability"


@query("a03_abstention", VIEWS + f"""SELECT *,
 CAST("correctAbstentions" AS DOUBLE) / nullif("unanswerableAnswered", 0) AS "correctAbstentionRate",
 CAST("unsupportedAnswers" AS DOUBLE) / nullif("unanswerableAnswered", 0) AS "unsupportedAnswerRate",
 CAST("falseAbstentions" AS DOUBLE) / nullif("answerableAnswered", 0) AS "falseAbstentionRate"
 FROM (SELECT "runId", count(*) FILTER ({_UN}) AS "unanswerableAnswered", count(*) FILTER ({_AN}) AS "answerableAnswered",
 count(*) FILTER ({_UN} AND judgment = 'abstain') AS "unanswerableAbstentions",
 count(*) FILTER ({_UN} AND judgment = 'abstain' AND correct) AS "correctAbstentions",
 count(*) FILTER ({_UN} AND judgment <> 'abstain') AS "unsupportedAnswers",
 count(*) FILTER ({_AN} AND judgment = 'abstain') AS "falseAbstentions" FROM outcome GROUP BY "runId")""")
def a03(spark, folder):
    return M.abstention(outcomes(spark, folder))


@query("a04_failures", VIEWS + """SELECT "runId", count(*) FILTER ("failureCategory" = 'budget') AS budget,
 count(*) FILTER ("failureCategory" = 'provider') AS provider, count(*) FILTER ("failureCategory" = 'adapter') AS adapter,
 count(*) FILTER ("failureCategory" = 'timeout') AS timeout,
 count(*) FILTER ("failureCategory" = 'unattempted') AS "unattemptedCount" FROM outcome GROUP BY "runId" """)
def a04(spark, folder):
    return M.failures(outcomes(spark, folder))


@query("a05_incomplete", VIEWS + """SELECT *, "incompleteCount" / total AS "incompleteProbeRate",
 "incompleteCount" / total > 0.05 AS "investigationRequired" FROM (SELECT "runId",
 count(*) FILTER ("failureCategory" IN ('provider', 'adapter', 'timeout')) AS "incompleteCount", count(*) AS total
 FROM outcome GROUP BY "runId")""")
def a05(spark, folder):
    return M.incomplete(outcomes(spark, folder))


@query("a06_token_distribution", VIEWS + """SELECT "runId", count(*) AS count, avg("totalTokens") AS mean,
 quantile_disc("totalTokens", 0.5) AS p50, quantile_disc("totalTokens", 0.95) AS p95,
 min("totalTokens") AS min, max("totalTokens") AS max FROM request GROUP BY "runId" """)
def a06(spark, folder):
    return M.latency(T.requests(spark, folder), "totalTokens")


@query("a07_token_totals", VIEWS + """SELECT *, CAST(stable AS DOUBLE) / nullif(stable + semi_stable + unstable, 0) AS stable_share,
 CAST(semi_stable AS DOUBLE) / nullif(stable + semi_stable + unstable, 0) AS semi_stable_share,
 CAST(unstable AS DOUBLE) / nullif(stable + semi_stable + unstable, 0) AS unstable_share FROM (
 SELECT "runId", count(*) AS "requestCount", CAST(sum("totalTokens") AS BIGINT) AS "totalInputTokens",
 CAST(sum(stable) AS BIGINT) AS stable, CAST(sum(semi_stable) AS BIGINT) AS semi_stable,
 CAST(sum(unstable) AS BIGINT) AS unstable, CAST(count(*) * 12 AS BIGINT) AS "requestOverheadTokens"
 FROM request GROUP BY "runId")""")
def a07(spark, folder):
    return M.tokens(T.requests(spark, folder))


@query("a08_token_efficiency", VIEWS + f""", acc AS (SELECT "runId", {_BLOCK} FROM outcome GROUP BY "runId"),
 tok AS (SELECT "runId", count(*) AS n, sum("totalTokens") AS t FROM request GROUP BY "runId")
 SELECT "runId", accuracy, CAST(n AS BIGINT) AS "requestCount", CAST(t AS BIGINT) AS "totalInputTokens",
 round(accuracy * n / t * 1000, 9) AS "accuracyPer1000InputTokens" FROM acc JOIN tok USING ("runId")""")
def a08(spark, folder):
    rows = M.token_efficiency(M.accuracy(outcomes(spark, folder)), M.tokens(T.requests(spark, folder)))
    return rows.select("runId", "accuracy", "requestCount", "totalInputTokens",
                       F.round("accuracyPer1000InputTokens", 9).alias("accuracyPer1000InputTokens"))


@query("a11_run_summary", VIEWS + """, life AS (SELECT "runId", CASE WHEN max_by(event_type, seq) = 'error' THEN 'terminated' ELSE 'completed' END AS status FROM request GROUP BY "runId"),
 o AS (SELECT "runId", count(*) AS "totalCount", count(*) FILTER (eligible) AS "answeredCount",
 count(*) FILTER ("failureCategory" IN ('provider', 'adapter', 'timeout')) AS "incompleteCount",
 count(*) FILTER ("failureCategory" = 'budget') AS "budgetCount", count(*) FILTER ("failureCategory" = 'provider') AS "providerCount",
 count(*) FILTER ("failureCategory" = 'adapter') AS "adapterCount", count(*) FILTER ("failureCategory" = 'timeout') AS "timeoutCount",
 count(*) FILTER (NOT attempted) AS "unattemptedCount" FROM outcome GROUP BY "runId"),
 r AS (SELECT "runId", count(*) AS "requestCount" FROM request GROUP BY "runId")
 SELECT "runId", status, coalesce("totalCount", 0) AS "totalCount", coalesce("answeredCount", 0) AS "answeredCount",
 coalesce("incompleteCount", 0) AS "incompleteCount", coalesce("budgetCount", 0) AS "budgetCount", coalesce("providerCount", 0) AS "providerCount",
 coalesce("adapterCount", 0) AS "adapterCount", coalesce("timeoutCount", 0) AS "timeoutCount", coalesce("unattemptedCount", 0) AS "unattemptedCount",
 coalesce("requestCount", 0) AS "requestCount", coalesce("answeredCount", 0) AS "accuracyDenominator",
 coalesce(CAST("answeredCount" AS DOUBLE) / nullif("totalCount", 0), 1.0) AS "completionRate",
 coalesce(CAST("incompleteCount" AS DOUBLE) / nullif("totalCount", 0) > 0.05, FALSE) AS "investigationRequired"
 FROM life LEFT JOIN o USING ("runId") LEFT JOIN r USING ("runId")""")
def a11(spark, folder):
    requests = T.requests(spark, folder)
    last = F.max_by("event_type", "seq")
    lifecycle = requests.groupBy("runId").agg(
        F.when(last == "error", "terminated").otherwise("completed").alias("status"))
    return M.run_summary(outcomes(spark, folder), requests, lifecycle)


_LATENCY = """SELECT "runId", count("latencyMs") AS count, round(avg("latencyMs"), 9) AS mean,
 quantile_disc("latencyMs", 0.5) AS p50, quantile_disc("latencyMs", 0.95) AS p95,
 min("latencyMs") AS min, max("latencyMs") AS max FROM {} GROUP BY "runId" """


@query("a12_request_latency", VIEWS + _LATENCY.format("request"))
def a12_requests(spark, folder):
    return M.latency(T.requests(spark, folder)).withColumn("mean", F.round("mean", 9))


@query("a12_probe_latency", VIEWS + _LATENCY.format("outcome"))
def a12_probes(spark, folder):
    return M.latency(outcomes(spark, folder)).withColumn("mean", F.round("mean", 9))


@query("a13_budget_failures", VIEWS + """, p AS (SELECT "runId", count(*) FILTER ("failureCategory" = 'budget') AS a FROM outcome GROUP BY "runId"),
 q AS (SELECT "runId", count(*) FILTER (status = 'error' AND category = 'budget') AS b FROM request GROUP BY "runId")
 SELECT "runId", coalesce(a, 0) AS "overBudgetFailures", coalesce(b, 0) AS "budgetRequestFailures" FROM p FULL JOIN q USING ("runId")""")
def a13(spark, folder):
    return M.budget_failures(outcomes(spark, folder), T.requests(spark, folder))


# Provenance on the order tables: an order is a probe of its customer's run, its line items are the
# sources it retrieved, a part is a turn whose facts are its brand and, for large sizes, its type.
PROVENANCE = """
WITH gold AS (SELECT o_custkey AS "runId", o_orderkey AS "probeId",
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ECONOMY' WHEN '2-HIGH' THEN 'STANDARD' WHEN '3-MEDIUM' THEN 'MEDIUM'
   WHEN '4-NOT SPECIFIED' THEN 'LARGE' END AS need FROM orders),
required AS (SELECT "runId", "probeId", need AS f FROM gold WHERE need IS NOT NULL
 UNION SELECT "runId", "probeId", 'Brand#' || (length(need) + 1) FROM gold WHERE need IS NOT NULL),
sources AS (SELECT DISTINCT "runId", "probeId", CAST(l_partkey AS VARCHAR) AS s FROM gold JOIN lineitem ON l_orderkey = "probeId" WHERE l_returnflag <> 'N'),
tf AS (SELECT CAST(p_partkey AS VARCHAR) AS s, p_brand AS f FROM part WHERE p_size > 5 UNION SELECT CAST(p_partkey AS VARCHAR), p_type FROM part WHERE p_size > 25),
evidence AS (SELECT DISTINCT "runId", "probeId", coalesce(f, s) AS f FROM sources LEFT JOIN tf USING (s)),
found AS (SELECT "runId", "probeId", count(*) AS "retrievedCount", count(r.f) AS "matchedCount"
 FROM evidence e LEFT JOIN required r USING ("runId", "probeId", f) GROUP BY 1, 2),
wanted AS (SELECT "runId", "probeId", count(*) AS n FROM required GROUP BY 1, 2),
perprobe AS (SELECT "runId", "probeId", CASE WHEN "retrievedCount" IS NULL THEN 'not-reported' ELSE 'reported' END AS status,
 "retrievedCount", coalesce(n, 0) AS "requiredCount", "matchedCount",
 CASE WHEN "retrievedCount" > 0 THEN CAST("matchedCount" AS DOUBLE) / "retrievedCount" WHEN "retrievedCount" = 0 AND n > 0 THEN 0.0 END AS "precision",
 CASE WHEN "retrievedCount" IS NOT NULL THEN CAST("matchedCount" AS DOUBLE) / nullif(n, 0) END AS recall
 FROM gold LEFT JOIN found USING ("runId", "probeId") LEFT JOIN wanted USING ("runId", "probeId"))
"""


def provenance(spark, folder):
    need = (F.when(F.col("o_orderpriority") == "1-URGENT", "ECONOMY")
            .when(F.col("o_orderpriority") == "2-HIGH", "STANDARD")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "LARGE"))
    gold = T.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("runId"), F.col("o_orderkey").alias("probeId"),
        F.lit("parts").alias("fixtureId"), need.alias("need"))
    required = gold.filter("need IS NOT NULL").select("runId", "probeId", F.explode(F.array(
        "need", F.concat(F.lit("Brand#"), F.length("need") + 1))).alias("factId"))
    lines = T.table(spark, folder, "lineitem").filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("probeId"), F.col("l_partkey").cast("string").alias("sourceId"))
    sources = lines.join(gold.select("runId", "probeId"), "probeId").select(
        "runId", "probeId", "sourceId").distinct()
    part = T.table(spark, folder, "part")
    facts = part.filter("p_size > 5").select(F.col("p_partkey").cast("string").alias("turnId"), F.explode(
        F.when(F.col("p_size") > 25, F.array("p_brand", "p_type")).otherwise(F.array("p_brand"))).alias("factId"))
    return gold, sources, facts.withColumn("fixtureId", F.lit("parts")).distinct(), required


@query("a10_retrieval_per_probe", PROVENANCE + "SELECT * FROM perprobe")
def a10(spark, folder):
    return M.relevance_per_probe(*provenance(spark, folder))


@query("a09_relevance", PROVENANCE + """SELECT "runId", CASE WHEN rc = 0 THEN 'not-reported' WHEN nr = 0 THEN 'reported' ELSE 'partial' END AS status,
 rc AS "reportedCount", nr AS "notReportedCount", CASE WHEN nr = 0 THEN p END AS "precision", CASE WHEN nr = 0 THEN r END AS recall,
 p AS "reportedPrecision", r AS "reportedRecall", pc AS "precisionDefinedCount", rec AS "recallDefinedCount" FROM (
 SELECT "runId", count(*) FILTER (status = 'reported') AS rc, count(*) FILTER (status <> 'reported') AS nr,
 round(avg("precision"), 9) AS p, round(avg(recall), 9) AS r, count("precision") AS pc, count(recall) AS rec FROM perprobe GROUP BY "runId")""")
def a09(spark, folder):
    rows = M.relevance(a10(spark, folder))
    means = ("precision", "recall", "reportedPrecision", "reportedRecall")
    return rows.withColumns({c: F.round(c, 9) for c in means})
