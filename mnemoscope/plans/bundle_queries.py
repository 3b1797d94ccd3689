"""Report documents of the event archive and curves over bundles that were published and read back."""

from pyspark.sql import functions as F

from mnemoscope.plans import bundles as B
from mnemoscope.plans import jobs as P
from mnemoscope.plans.archive_queries import REPORTS, reports
from mnemoscope.plans.catalog import query
from mnemoscope.plans.metric_queries import VIEWS
from mnemoscope.session import scratch_folder
from mnemoscope.sources import publish, published
from mnemoscope.sources import tables as T


@query("job_report_documents", VIEWS + """, o AS (SELECT "runId", CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(eligible AS INT)) AS BIGINT) AS answered, count(*) AS total,
  count(*) FILTER (ability = 'abstention') AS unanswerable, count(*) FILTER (eligible AND NOT answerability AND judgment = 'abstain' AND correct) AS "correctAbstentions",
  count(DISTINCT "sessionDistance") AS distances, count(*) FILTER ("failureCategory" IN ('provider', 'adapter', 'timeout')) AS "incompleteCount",
  to_json(list(DISTINCT CAST("sessionDistance" AS VARCHAR) ORDER BY CAST("sessionDistance" AS VARCHAR))) AS labels FROM outcome GROUP BY 1),
 r AS (SELECT "runId", count(*) AS requests, CAST(sum("totalTokens") AS BIGINT) AS tokens, max("latencyMs") AS slowest FROM request GROUP BY 1)
 SELECT "runId", correct, answered, total, nullif(unanswerable, 0) AS unanswerable, "correctAbstentions", CAST(labels AS VARCHAR) AS labels, "incompleteCount", requests, tokens, slowest, CAST(0 AS INT) AS problems FROM o JOIN r USING ("runId")""")
def job_documents(spark, folder):
    """All metrics of every run as one document and manifest, published, read back and verified."""
    requests = T.requests(spark, folder).withColumn("tierSegments", F.array(F.struct(F.array("event_type").alias("sourceIds"))))
    gold = T.gold(spark, folder)
    required = gold.select("runId", "probeId", F.col("ability").alias("factId"))
    facts = gold.select("fixtureId", F.lit("click").alias("turnId"), F.col("ability").alias("factId")).distinct()
    report = P.report_runs(gold, T.captured(spark, folder), T.scores(spark, folder), requests, facts, required)
    runs = gold.groupBy("runId", F.sha2("fixtureId", 256).alias("fixtureHash")).agg(F.min("seq").alias("arrival"))
    path = scratch_folder(spark, "reports")
    B.publish_bundles(B.bundles(B.report_documents(report), runs), path)
    rows = B.checked_bundles(published.published(spark, path))

    def at(place, kind="bigint"):
        return F.try_variant_get("_report", place, kind)
    # Keys stand in the document in text order: 10 before 9.
    distances = F.map_keys(at("$.breakdown.sessionDistance", "map<string,variant>"))
    return rows.select(
        "runId", *[at(f"$.accuracy.{c}").alias(c) for c in ("correct", "answered", "total")], at("$.breakdown.ability.abstention.total").alias("unanswerable"),
        at("$.abstention.correctAbstentions").alias("correctAbstentions"), F.to_json(distances).alias("labels"), at("$.operationalTelemetry.counts.incompleteCount").alias("incompleteCount"),
        at("$.tokenEfficiency.totals.requestCount").alias("requests"), at("$.tokenEfficiency.totals.totalInputTokens").alias("tokens"),
        at("$.operationalTelemetry.requestLatencyMs.max", "double").alias("slowest"), F.size("problems").alias("problems"))


def _published_reports(spark, folder):
    """Reports of customers as bundles.  Of some the document changed after the manifest was written, of others the manifest."""
    rows = reports(spark, folder)
    accuracy = rows.select(F.col("arrival").alias("runId"), "correct", "answered", "total", "accuracy", "completionRate")
    report = P.Report(accuracy, *[None] * 9)
    runs = rows.select(F.col("arrival").alias("runId"), "arrival", "model", "seed", "scale", "fixtureHash", "deterministic")
    made = B.bundles(B.report_documents(report), runs).withColumns({
        "report": F.when(F.col("runId") % 7 == 0, F.replace("report", F.lit('"total":'), F.lit('"total":1'))).otherwise(F.col("report")),
        "manifest": F.when(F.col("runId") % 7 == 1, F.replace("manifest", F.lit('"scale":10'), F.lit('"scale":50'))).otherwise(F.col("manifest"))})
    path = scratch_folder(spark, "bundles")
    B.publish_bundles(made, path)
    return B.checked_bundles(published.published(spark, path))


@query("job_curves_from_bundles", REPORTS + """, sound AS (SELECT * FROM pts WHERE arrival % 7 <> 0 AND NOT (arrival % 7 = 1 AND scale <> 500)) SELECT arrival AS "runId", model, seed, scale, correct, answered, total, accuracy,
 row_number() OVER (PARTITION BY model, seed, scale ORDER BY arrival) AS repeat FROM sound""")
def job_curves(spark, folder):
    curves = P.compare_reports(B.curve_reports(_published_reports(spark, folder)))
    return curves["points"].select("runId", F.get_json_object(F.concat(F.lit('{"v":'), "model", F.lit("}")), "$.v").alias("model"),
                                   F.get_json_object(F.concat(F.lit('{"v":'), "seed", F.lit("}")), "$.v").alias("seed"),
                                   "scale", "correct", "answered", "total", "accuracy", "repeat")


@query("s08_bundle_problems", REPORTS + """SELECT arrival AS "runId", CASE WHEN arrival % 7 = 0 THEN 'hash differs,total size differs' ELSE 'bundle is not named after its manifest' END AS problems
 FROM pts WHERE arrival % 7 = 0 OR arrival % 7 = 1 AND scale <> 500""")
def s08(spark, folder):
    return _published_reports(spark, folder).filter("size(problems) > 0").select("runId", F.array_join("problems", ",").alias("problems"))


@query("s10_footprint", """SELECT o_custkey AS bundle, CAST(sum(o_orderkey * 10000) AS BIGINT) AS "artifactSizeBytes", sum(o_orderkey * 10000) > 5000000000 AS warned FROM orders GROUP BY 1""")
def s10(spark, folder):
    """Every customer's orders are the files of a bundle."""
    files = T.table(spark, folder, "orders").select(F.col("o_custkey").alias("bundle"), (F.col("o_orderkey") * 10000).alias("bytes"))
    return publish.footprint(files).select("bundle", "artifactSizeBytes", (F.size("warnings") > 0).alias("warned"))


@query("a26_file_set_hash", """SELECT p_brand AS bundle, sha256(string_agg(p_partkey || chr(0) || sha256(p_name), chr(10) ORDER BY p_partkey || chr(0) || sha256(p_name))) AS "setHash" FROM part GROUP BY 1""")
def a26(spark, folder):
    """Every brand's parts are the files of a code bundle."""
    files = T.table(spark, folder, "part").select(F.col("p_brand").alias("bundle"), F.col("p_partkey").cast("string").alias("name"), F.sha2("p_name", 256).alias("sha256"))
    return publish.file_set_hash(files)
