"""Archive, chronology, curve and calibration queries over the event, text and order tables."""

from pyspark.sql import functions as F

from mnemoscope.functions.text import normalize
from mnemoscope.operators import archive as A
from mnemoscope.operators import calibration as C
from mnemoscope.operators import curves as V
from mnemoscope.operators import metrics as M
from mnemoscope.plans.catalog import query
from mnemoscope.plans.metric_queries import VIEWS, outcomes
from mnemoscope.sources import tables as T


@query("j03_linked_requests", VIEWS + """SELECT c."runId", c."probeId", 0 AS position, c."requestId", CASE WHEN r.status IS NULL THEN 'the archive has no such request of this probe'
 WHEN r.value > 200 THEN 'the copy of the request in the probe differs' END AS problem FROM captured c LEFT JOIN request r USING ("runId", "requestId")""")
def j03(spark, folder):
    requests = T.requests(spark, folder)
    identities = A.compact_identity(requests.select("runId", "requestId", "probeId", "status", "seq", "totalTokens"))
    claimed = A.compact_identity(requests.withColumn("seq", F.when(F.col("value") > 200, -1).otherwise(F.col("seq")))
                                 .select("runId", "requestId", "probeId", "status", "seq", "totalTokens"))
    named = claimed.groupBy("runId", "requestId").agg(F.first("hash").alias("hash"))
    probes = T.captured(spark, folder).join(named, ["runId", "requestId"]).select(
        "runId", "probeId", "eligibleForAccuracy", F.array(F.struct("requestId", "hash")).alias("requests"))
    return A.linked_requests(probes, identities)


@query("j08_uncaptured_references", VIEWS + """SELECT "runId", "probeId", "requestId" FROM request WHERE "probeId" IS NOT NULL
 AND ("runId", "probeId") NOT IN (SELECT "runId", "probeId" FROM captured)""")
def j08(spark, folder):
    rows = T.requests(spark, folder).filter("probeId IS NOT NULL").select("runId", "probeId", "requestId")
    return A.unknown_references(rows, T.captured(spark, folder), ["runId", "probeId"])


@query("j09_coverage", VIEWS + """SELECT "runId", "probeId", 'missing' AS problem FROM gold WHERE ("runId", "probeId") NOT IN (SELECT "runId", "probeId" FROM captured)""")
def j09(spark, folder):
    return A.coverage(T.gold(spark, folder), T.captured(spark, folder), ["runId", "probeId"])


@query("j11_tier_totals", VIEWS + """SELECT "runId", row_number() OVER (PARTITION BY "runId" ORDER BY seq) AS position, 'differs' AS problem FROM request QUALIFY "totalTokens" > 25000""")
def j11(spark, folder):
    requests = T.requests(spark, folder)
    archived = A.tier_totals(requests)
    # A manifest that caps what it records at the budget differs exactly for over-budget requests.
    manifest = A.tier_totals(requests.withColumn("totalTokens", F.least("totalTokens", F.lit(25_000))))
    name = F.to_json(F.struct("requestId", "totalTokens"))
    return A.positional_diff(archived.withColumn("identity", name), manifest.withColumn("identity", name), ["runId", "position"])


@query("j13_declared_requests", VIEWS + """SELECT "runId", "requestId" AS "unitId", 0 AS position,
 CASE WHEN event_type = 'signup' AND value < 5 THEN 'missing' ELSE 'differs' END AS problem
 FROM request WHERE (event_type = 'signup' AND value < 5) OR (event_type = 'error' AND k < 25)""")
def j13(spark, folder):
    requests = T.requests(spark, folder).withColumn("tierSegments", F.array(F.struct(
        F.lit("stable").alias("tier"), F.col("event_type").alias("content"), F.col("totalTokens").alias("tokenCount"))))
    unit = [F.col("requestId").alias("unitId"), F.lit(0).alias("position")]
    observed = A.request_identity(requests.select("runId", *unit, "requestId", "tierSegments"), ["runId", "unitId", "position"])
    kept = requests.filter("NOT (event_type = 'signup' AND value < 5)")
    # Claimed token counts are no part of the identity; the content is.
    changed = kept.withColumn("tierSegments", F.transform("tierSegments", lambda s: s.withField("tokenCount", F.lit(0).cast("bigint"))))
    changed = changed.withColumn("tierSegments", F.when(
        (F.col("event_type") == "error") & (F.col("k") < 25),
        F.transform("tierSegments", lambda s: s.withField("content", F.lit("other")))).otherwise(F.col("tierSegments")))
    declared = A.request_identity(changed.select("runId", *unit, "requestId", "tierSegments"), ["runId", "unitId", "position"])
    return A.positional_diff(observed, declared, ["runId", "unitId", "position"])


@query("j15_replay_diff", VIEWS + """SELECT "runId", seq, CASE WHEN status = 'error' AND category = 'timeout' THEN 'missing' ELSE 'differs' END AS problem
 FROM request WHERE (status = 'error' AND category = 'timeout') OR (event_type = 'purchase' AND k > 95)""")
def j15(spark, folder):
    requests = T.requests(spark, folder)
    archived = requests.select("runId", "seq", F.concat_ws("|", "requestId", "event_type").alias("identity"))
    replayed = requests.filter("NOT (status = 'error' AND category = 'timeout')").select(
        "runId", "seq", F.concat_ws("|", "requestId", F.when((F.col("event_type") == "purchase") & (F.col("k") > 95), "x")
                                    .otherwise(F.col("event_type"))).alias("identity"))
    return A.positional_diff(archived, replayed, ["runId", "seq"])


@query("a18_run_timing", VIEWS + """, e AS (SELECT "runId", seq AS position, ts, CASE event_type WHEN 'view' THEN 'run_started' WHEN 'error' THEN 'run_completed' WHEN 'click' THEN 'resume' ELSE 'turn' END AS type FROM request),
 s AS (SELECT "runId", arg_min(ts, position) FILTER (type = 'run_started') AS "startedAt", arg_max(ts, position) FILTER (type = 'run_completed') AS "endedAt",
 count(*) FILTER (type = 'resume') AS "historyEvents", count(*) AS "requestCount" FROM e GROUP BY "runId"),
 d AS (SELECT *, (epoch_us("endedAt") - epoch_us("startedAt")) / 1e6 AS el FROM s)
 SELECT "runId", "startedAt", "endedAt", "historyEvents", "requestCount", CASE WHEN el >= 0 THEN el END AS "elapsedSeconds",
 CASE WHEN el > 0 THEN "requestCount" / el END AS "requestsPerSecond" FROM d""")
def a18(spark, folder):
    requests = T.requests(spark, folder)
    kind = (F.when(F.col("event_type") == "view", "run_started").when(F.col("event_type") == "error", "run_completed")
            .when(F.col("event_type") == "click", "resume").otherwise("turn"))
    events = requests.select("runId", F.col("seq").alias("position"), kind.alias("type"), "ts")
    return A.run_timing(events, requests.groupBy("runId").agg(F.count(F.lit(1)).alias("requestCount")))


@query("a20_duplicates", """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def a20(spark, folder):
    return A.duplicates(T.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a21_ordered_totals", VIEWS + """SELECT "runId", row_number() OVER (PARTITION BY "runId" ORDER BY seq) AS position, "requestId", "totalTokens" FROM request""")
def a21(spark, folder):
    return A.tier_totals(T.requests(spark, folder))


def _order_requests(spark, folder):
    """Orders as requests with two segments each: the order line counts come from whole tables."""
    tier = F.when(F.col("o_orderstatus") == "F", "stable").when(F.col("o_orderstatus") == "O", "semi-stable").otherwise("unstable")
    return T.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("runId"), F.col("o_orderkey").alias("requestId"),
        F.array(
            F.struct(tier.alias("tier"), F.floor("o_totalprice").cast("bigint").alias("tokenCount"),
                     F.array("o_orderpriority", "o_orderstatus").alias("sourceIds")),
            F.struct(F.lit("unstable").alias("tier"), F.length("o_orderpriority").cast("bigint").alias("tokenCount"),
                     F.array("o_orderstatus", F.lit("s"), "o_orderpriority").alias("sourceIds"))).alias("tierSegments"),
        F.lit(3).cast("bigint").alias("requestOverheadTokens"))


@query("a25_tier_tokens", """SELECT o_orderkey AS "requestId", CASE WHEN o_orderstatus = 'F' THEN t ELSE 0 END AS stable, CASE WHEN o_orderstatus = 'O' THEN t ELSE 0 END AS semi_stable,
 CASE WHEN o_orderstatus = 'P' THEN t ELSE 0 END + n AS unstable, t + n + 3 AS total, t + n + 3 > 25000 AS "overBudget"
 FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS t, length(o_orderpriority) AS n FROM orders)""")
def a25(spark, folder):
    return A.tier_tokens(_order_requests(spark, folder)).select(
        "requestId", "stable", "semi_stable", "unstable", "total", "overBudget")


@query("a24_ordered_sources", """SELECT o_orderkey AS "requestId", [o_orderpriority, o_orderstatus, 's'] AS sources FROM orders""")
def a24(spark, folder):
    rows = _order_requests(spark, folder)
    return rows.select("requestId", A.ordered_sources(F.array(F.struct("tierSegments"))).alias("sources"))


@query("w07_context_growth", """SELECT conv_id AS "runId", turn AS seq, length(text) AS tokens, CAST(sum(length(text)) OVER w AS BIGINT) AS "contextTokens", sum(length(text)) OVER w > 2500 AS "overBudget"
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w07(spark, folder):
    turns = T.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("runId"), F.col("turn").alias("seq"), F.char_length("text").cast("bigint").alias("tokens"))
    return A.context_growth(turns, budget=2_500)


@query("w07_first_over_budget", """SELECT "runId", count(*) AS turns, max(c) AS "finalTokens", min(seq) FILTER (c > 2500) AS "firstOverBudget" FROM (
 SELECT conv_id AS "runId", turn AS seq, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS c FROM conversations) GROUP BY "runId" """)
def w07_first(spark, folder):
    return A.first_over_budget(w07(spark, folder))


@query("w08_prefix_changes", """SELECT event_id AS seq, user_id AS "runId", event_type AS "stablePrefixHash" FROM events e
 JOIN (SELECT user_id, arg_min(event_type, event_id) AS f FROM events GROUP BY 1) USING (user_id) WHERE event_type <> f""")
def w08(spark, folder):
    rows = T.table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("runId"), F.col("event_type").alias("stablePrefixHash"))
    return A.prefix_changes(rows)


@query("w09_retry_audit", VIEWS + """, h AS (SELECT "runId", "requestId", k, CASE WHEN k < 30 THEN 1 WHEN k < 60 THEN 2 WHEN k < 90 THEN 4 ELSE 5 END AS n FROM request)
 SELECT "runId", "requestId", n AS "attemptsMade", CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 4 THEN 7.0 + CASE WHEN k > 80 THEN 24.0 ELSE 0 END ELSE 15.0 + 24.0 END AS "retryWaitSeconds",
 CASE WHEN n = 5 THEN 'more than four attempts' WHEN n = 4 AND k > 80 THEN 'retry wait above 30 seconds' WHEN n > 1 AND k % 2 = 1 THEN 'a final status was retried' END AS problem FROM h""")
def w09(spark, folder):
    k = F.col("k")
    n = F.when(k < 30, 1).when(k < 60, 2).when(k < 90, 4).otherwise(5)
    code = F.when(k % 2 == 1, "500").otherwise("503")
    history = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("attempt"), F.when(i < n, code).otherwise("ok").alias("status"),
        F.when(i < n, F.pow(F.lit(2.0), (i - 1).cast("double"))).alias("backoffSeconds"),
        F.when((i == 2) & (k > 80), F.lit(24.0)).alias("rateWaitSeconds")))
    return A.retry_audit(T.requests(spark, folder).withColumn("retryHistory", history).withColumn("attempts", n))


RATE = """, p AS (SELECT event_type AS provider, seq, ts, epoch_us(ts) AS t, row_number() OVER w AS i FROM request WINDOW w AS (PARTITION BY event_type ORDER BY ts, seq)),
 m AS (SELECT *, max(t - (i - 1) * 600000000) OVER (PARTITION BY provider ORDER BY ts, seq) AS peak FROM p)
 SELECT provider, seq, ts, i AS position, greatest(peak + (i - 1) * 600000000 - t, 0) AS "waitMicros" FROM m"""


@query("t07_rate_audit", VIEWS + RATE)
def t07(spark, folder):
    # Six requests an hour: slow enough for the event log to queue.
    rows = T.requests(spark, folder).select(F.col("event_type").alias("provider"), "seq", "ts")
    return A.rate_audit(rows, rpm=0.1)


@query("t09_retryable", """SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linenumber IN (2, 5)) AS retryable FROM lineitem GROUP BY 1""")
def t09(spark, folder):
    code = F.when(F.col("l_linenumber") == 2, "429").when(F.col("l_linenumber") == 5, "503").otherwise("400")
    return T.table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(A.retryable(code)).alias("retryable"))


@query("w12_telemetry_order", """SELECT * FROM (SELECT conv_id AS "runId", conv_id || '-' || turn AS "requestId", row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "logPosition",
 row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS "unitPosition" FROM conversations) WHERE "logPosition" <> "unitPosition" """)
def w12(spark, folder):
    rows = T.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("runId"), F.concat_ws("-", "conv_id", "turn").alias("requestId"), "role", F.col("turn").alias("seq"))
    return A.telemetry_order(rows.withColumn("at", F.col("seq")), "role", "at")


@query("t03_discard_partial_sessions", """WITH rec AS (SELECT conv_id AS "runId", turn AS "sessionIndex", CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 ELSE 2 END AS attempt, length(text) AS n FROM conversations),
 res AS (SELECT DISTINCT "runId", attempt, attempt * 2 AS "lastCompletedSession" FROM rec WHERE attempt > 0)
 SELECT * FROM rec r WHERE NOT EXISTS (SELECT 1 FROM res x WHERE x."runId" = r."runId" AND x.attempt > r.attempt AND x."lastCompletedSession" < r."sessionIndex")""")
def t03(spark, folder):
    attempt = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 0).otherwise(2)
    records = T.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("runId"), F.col("turn").alias("sessionIndex"), attempt.alias("attempt"), F.length("text").alias("n"))
    resumes = records.filter("attempt > 0").select("runId", "attempt", (F.col("attempt") * 2).alias("lastCompletedSession")).distinct()
    return A.discard_partial_sessions(records, resumes)


# Every customer is a run: its market segment is the model, its nation gives seed and scale, its
# orders the probes.
REPORTS = """WITH rep AS (SELECT 'm-' || c_custkey AS "manifestHash", c_custkey AS arrival, c_mktsegment AS model, CAST(c_nationkey // 5 AS VARCHAR) AS seed,
 CASE c_nationkey // 7 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 500 ELSE 1000 END AS scale, 'h' || (c_nationkey // 3) AS "fixtureHash",
 CASE c_mktsegment WHEN 'BUILDING' THEN TRUE WHEN 'MACHINERY' THEN FALSE END AS deterministic FROM customer),
 cnt AS (SELECT o_custkey AS arrival, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS answered, count(*) FILTER (o_orderstatus = 'F') AS correct FROM orders GROUP BY 1),
 pts AS (SELECT *, CAST(correct AS DOUBLE) / nullif(answered, 0) AS accuracy, CAST(answered AS DOUBLE) / nullif(total, 0) AS "completionRate" FROM rep JOIN cnt USING (arrival)) """


def reports(spark, folder):
    nation = F.col("c_nationkey")
    band = F.expr("c_nationkey div 7")
    runs = T.table(spark, folder, "customer").select(
        F.concat(F.lit("m-"), F.col("c_custkey")).alias("manifestHash"), F.col("c_custkey").alias("arrival"),
        F.col("c_mktsegment").alias("model"), F.expr("c_nationkey div 5").cast("string").alias("seed"),
        F.when(band == 0, 10).when(band == 1, 100).when(band == 2, 500).otherwise(1000).alias("scale"),
        F.concat(F.lit("h"), F.expr("c_nationkey div 3")).alias("fixtureHash"),
        F.when(F.col("c_mktsegment") == "BUILDING", True).when(F.col("c_mktsegment") == "MACHINERY", False).alias("deterministic"), nation)
    counts = T.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("arrival")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") != "P").alias("answered"),
        F.count_if(F.col("o_orderstatus") == "F").alias("correct"))
    rows = runs.join(counts, "arrival")
    return V.curve_points(rows.withColumn("accuracy", M.ratio("correct", "answered")).withColumn("completionRate", M.ratio("answered", "total")))


@query("a17_repeat_variance", REPORTS + """SELECT model, seed, scale, "fixtureHash", count(*) AS runs, count(accuracy) AS "accuracyCount",
 CASE WHEN count(accuracy) > 1 THEN round(var_pop(accuracy), 9) END AS "accuracyVariance", count("completionRate") AS "completionRateCount",
 CASE WHEN count("completionRate") > 1 THEN round(var_pop("completionRate"), 9) END AS "completionRateVariance", CASE WHEN count(*) > 1 THEN 'reported' ELSE 'not-reported' END AS status
 FROM pts WHERE NOT coalesce(deterministic, FALSE) GROUP BY 1, 2, 3, 4""")
def a17(spark, folder):
    points = reports(spark, folder)
    names = points.select("seriesId", "model", "seed").distinct()
    rows = V.repeat_variance(points).join(names, "seriesId").drop("seriesId")
    return rows.withColumns({c: F.round(c, 9) for c in ("accuracyVariance", "completionRateVariance")})


@query("w05_repeat_index", REPORTS + """SELECT "manifestHash", scale, row_number() OVER (PARTITION BY model, seed, scale ORDER BY arrival, "manifestHash") AS repeat FROM pts""")
def w05(spark, folder):
    return V.repeat_index(reports(spark, folder)).select("manifestHash", "scale", "repeat")


@query("w06_curve_segments", REPORTS + """, num AS (SELECT *, row_number() OVER (PARTITION BY model, seed, scale ORDER BY arrival, "manifestHash") AS repeat FROM pts),
 line AS (SELECT DISTINCT model, seed, repeat FROM num), spine AS (SELECT l.*, s.scale, n.accuracy AS value FROM line l CROSS JOIN (VALUES (10), (100), (500), (1000)) s(scale) LEFT JOIN num n USING (model, seed, repeat, scale)),
 seg AS (SELECT *, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY model, seed, repeat ORDER BY scale) AS BIGINT) AS segment FROM spine)
 SELECT model, seed, repeat, scale, value, segment, CASE WHEN row_number() OVER (PARTITION BY model, seed, repeat, segment ORDER BY scale) = 1 THEN 'M' ELSE 'L' END AS command FROM seg WHERE value IS NOT NULL""")
def w06(spark, folder):
    points = reports(spark, folder)
    names = points.select("seriesId", "model", "seed").distinct()
    return V.segments(V.repeat_index(points), "accuracy").join(names, "seriesId").drop("seriesId")


@query("u05_missing_scales", REPORTS + """SELECT model, seed, scale FROM (SELECT DISTINCT model, seed FROM pts) CROSS JOIN (VALUES (10), (100), (500), (1000)) s(scale)
 EXCEPT SELECT model, seed, scale FROM pts""")
def u05(spark, folder):
    points = reports(spark, folder)
    names = points.select("seriesId", "model", "seed").distinct()
    return V.missing_scales(points).join(names, "seriesId").drop("seriesId")


@query("j14_comparability", """SELECT a.c_custkey AS "runA", b.c_custkey AS "runB", a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AS comparable,
 list_filter([CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'model' END, CASE WHEN a.c_nationkey <> b.c_nationkey THEN 'seed' END], lambda x: x IS NOT NULL) AS mismatches,
 NOT (a.c_acctbal > 0 AND b.c_acctbal > 0) AS "varianceRequired" FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1""")
def j14(spark, folder):
    runs = T.table(spark, folder, "customer")
    manifests = runs.select(F.col("c_custkey").alias("runId"), F.col("c_mktsegment").alias("model"),
                            F.col("c_nationkey").alias("seed"), (F.col("c_acctbal") > 0).alias("deterministic"))
    # Each run is compared with the next one, where there is one.
    pairs = runs.select(F.col("c_custkey").alias("runA"), (F.col("c_custkey") + 1).alias("runB")).join(
        runs.select(F.col("c_custkey").alias("runB")), "runB")
    return V.comparability(manifests, pairs)


CALIBRATION = """WITH rows AS (SELECT lang AS "calibrationSetId", doc_id AS "probeId", source, CASE quality WHEN 1 THEN 'pass' ELSE 'fail' END AS "goldJudgment",
 CASE WHEN n_chars > 500 THEN 'pass' ELSE 'fail' END AS judgment, CASE toxic WHEN 1 THEN 'semantic' ELSE 'exact' END AS "matchType",
 CASE WHEN n_chars < 300 THEN 'abstention' WHEN n_chars < 900 THEN 'knowledge-update' WHEN n_chars < 2000 THEN 'temporal-reasoning' WHEN n_chars < 4000 THEN 'cross-session-reasoning' ELSE 'information-extraction' END AS ability
 FROM labels JOIN documents USING (doc_id)) """


def calibration_rows(spark, folder):
    n = F.col("n_chars")
    ability = (F.when(n < 300, "abstention").when(n < 900, "knowledge-update").when(n < 2000, "temporal-reasoning")
               .when(n < 4000, "cross-session-reasoning").otherwise("information-extraction"))
    documents = T.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return T.table(spark, folder, "labels").join(documents, "doc_id").select(
        F.col("lang").alias("calibrationSetId"), F.col("doc_id").alias("probeId"), "source",
        F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("goldJudgment"),
        F.when(n > 500, "pass").otherwise("fail").alias("judgment"),
        F.when(F.col("toxic") == 1, "semantic").otherwise("exact").alias("matchType"), ability.alias("ability"))


def _agreed(spark, folder):
    rows = calibration_rows(spark, folder)
    return C.agreements(rows, rows.select("calibrationSetId", "probeId", "judgment"), ["calibrationSetId", "probeId"])


@query("a14_scorer_agreement", CALIBRATION + """SELECT "calibrationSetId", m AS matched, t AS total, CAST(m AS DOUBLE) / t AS agreement, m * 100 >= t * 95 AS approved
 FROM (SELECT "calibrationSetId", count(*) FILTER (judgment = "goldJudgment") AS m, count(*) AS t FROM rows GROUP BY 1)""")
def a14(spark, folder):
    return C.gate(_agreed(spark, folder), ["calibrationSetId"])


@query("a14_mismatches", CALIBRATION + """SELECT "calibrationSetId", "probeId", "goldJudgment", judgment FROM rows WHERE judgment <> "goldJudgment" """)
def a14_mismatches(spark, folder):
    return _agreed(spark, folder).filter("NOT agrees").select("calibrationSetId", "probeId", "goldJudgment", "judgment")


_ABILITIES = ("information-extraction", "cross-session-reasoning", "temporal-reasoning", "knowledge-update", "abstention")
_KINDS = ("exact", "ordered-list", "numeric", "semantic", "abstain")


@query("a15_strata", CALIBRATION + ", c AS (SELECT \"calibrationSetId\", count(*) AS rows, " + ", ".join(
    [f"count(*) FILTER (ability = '{a}') AS \"{a}\"" for a in _ABILITIES]
    + [f"count(*) FILTER (\"matchType\" = '{m}') AS \"match_{m}\"" for m in _KINDS]) + """ FROM rows GROUP BY 1)
 SELECT *, rows BETWEEN 90 AND 110 AS "sizeOk", least("information-extraction", "cross-session-reasoning", "temporal-reasoning", "knowledge-update", "abstention") >= 10 AS "abilitiesOk",
 least("match_exact", "match_ordered-list", "match_numeric", "match_semantic", "match_abstain") > 0 AS "matchTypesOk", "match_semantic" * 10 >= rows * 3 AS "semanticOk" FROM c""")
def a15(spark, folder):
    return C.strata(calibration_rows(spark, folder))


@query("a16_declared_counts", CALIBRATION + """, act AS (SELECT "calibrationSetId", 'abilities' AS dimension, ability AS label FROM rows UNION ALL SELECT "calibrationSetId", 'matchTypes', "matchType" FROM rows
 UNION ALL SELECT "calibrationSetId", 'goldJudgments', "goldJudgment" FROM rows UNION ALL SELECT "calibrationSetId", 'edgeCases', source FROM rows UNION ALL SELECT "calibrationSetId", 'edgeCases', judgment FROM rows),
 a AS (SELECT "calibrationSetId", dimension, label, count(*) AS actual FROM act GROUP BY 1, 2, 3), d AS (SELECT "calibrationSetId", 'edgeCases' AS dimension, source AS label, count(*) AS declared FROM rows GROUP BY 1, 3)
 SELECT "calibrationSetId", dimension, label, actual, declared FROM a FULL JOIN d USING ("calibrationSetId", dimension, label) WHERE actual IS DISTINCT FROM declared""")
def a16(spark, folder):
    rows = calibration_rows(spark, folder).withColumn("edgeCases", F.array("source", "judgment"))
    declared = rows.groupBy("calibrationSetId", F.lit("edgeCases").alias("dimension"), F.col("source").alias("label")).agg(
        F.count(F.lit(1)).alias("declared"))
    return C.declared_counts(rows, declared)


@query("j10_review_problems", CALIBRATION + """SELECT "calibrationSetId", "probeId", CASE WHEN ability = 'abstention' THEN 'missing' WHEN source = 'src1' THEN 'the review leaves the label unconfirmed'
 ELSE 'the review confirms another judgment' END AS problem FROM rows WHERE ability = 'abstention' OR source = 'src1' OR judgment <> "goldJudgment" """)
def j10(spark, folder):
    rows = calibration_rows(spark, folder)
    reviews = rows.filter("ability <> 'abstention'").select(
        "calibrationSetId", "probeId", F.col("judgment").alias("confirmedGoldJudgment"),
        F.lit(True).alias("justificationConsistent"), (F.col("source") != "src1").alias("evidenceConsistent"))
    return C.review_problems(rows, reviews)


@query("a23_provenance", """SELECT doc_id, CASE WHEN lang = 'fr' OR source = 'src2' THEN 'agent' WHEN n_chars > 1000 AND n_chars < 3000 THEN 'human' WHEN n_chars <= 100 THEN 'agent' ELSE 'unknown' END AS kind FROM documents""")
def a23(spark, folder):
    n = F.col("n_chars")
    corpora = T.table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("calibrationSetId"), F.lit("-").alias("rowsHash"),
        F.when(F.col("lang") == "fr", "Written by the same AGENT").otherwise("by hand").alias("labelingMethod"),
        F.lit("second pass").alias("reviewMethod"), F.when(n > 1000, "human").when(n <= 100, "agent").alias("labelKind"),
        F.lit("ann").alias("labelerId"), F.lit("human").alias("reviewKind"),
        F.when(n < 3000, F.lit("bo")).otherwise(F.lit(" ")).alias("reviewerId"))
    return C.provenance(corpora, frozen_set_ids=("src2",)).select("doc_id", "kind")


@query("j17_separation", """WITH q AS (SELECT DISTINCT item_id, trim(regexp_replace(replace(lower(u), 'ß', 'ss'), '\\s+', ' ', 'g')) AS question FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS u FROM benchmark)),
 d AS (SELECT DISTINCT trim(regexp_replace(replace(lower(u), 'ß', 'ss'), '\\s+', ' ', 'g')) AS question FROM (SELECT unnest(string_split(text, chr(10))) AS u FROM documents))
 SELECT item_id, question FROM q WHERE question <> '' AND question IN (SELECT question FROM d)""")
def j17(spark, folder):
    # A question is one line of a text; every line of every document is compared.
    def lines(name, *keys):
        rows = T.table(spark, folder, name).select(*keys, F.explode(F.split("text", "\n")).alias("u"))
        return rows.select(*keys, normalize(F.col("u")).alias("question")).filter("question <> ''")
    return C.separation(lines("benchmark", "item_id").distinct(), lines("documents"))


@query("p06_compact_identities", VIEWS + """SELECT "runId", status, count(*) AS requests, count(DISTINCT "requestId") AS identities FROM request GROUP BY 1, 2""")
def p06(spark, folder):
    rows = A.compact_identity(A.archived_request(T.requests(spark, folder)).select("runId", "requestId", "totalTokens").join(
        T.requests(spark, folder).select("runId", "requestId", "probeId", "status"), ["runId", "requestId"]))
    return rows.groupBy("runId", "status").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("hash").alias("identities"))


@query("p08_over_budget", VIEWS + """SELECT "runId", "requestId", "totalTokens" FROM request WHERE "totalTokens" > 25000""")
def p08(spark, folder):
    from mnemoscope.functions.tokens import over_budget
    return T.requests(spark, folder).filter(over_budget(F.col("totalTokens"))).select("runId", "requestId", "totalTokens")


@query("p07_eligible", VIEWS + """SELECT "runId", count(*) FILTER (eligible) AS eligible, count(*) AS probes FROM outcome GROUP BY 1""")
def p07(spark, folder):
    return outcomes(spark, folder).groupBy("runId").agg(
        F.count_if("eligible").alias("eligible"), F.count(F.lit(1)).alias("probes"))
