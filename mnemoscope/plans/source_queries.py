"""Logs written to files and read back, redacted appends, restarts, and odd times and latencies."""

from pyspark.sql import functions as F

from mnemoscope.functions.redact import redact_json, redact_text
from mnemoscope.functions.text import zoned_timestamp
from mnemoscope.operators import metrics as M
from mnemoscope.plans.catalog import query
from mnemoscope.session import scratch_folder
from mnemoscope.sources import jsonl
from mnemoscope.sources import tables as T
from mnemoscope.streaming import ingest as I


@query("s02_read_jsonl", """SELECT 'run-' || user_id AS "runId", count(*) FILTER (event_type <> 'error') AS records, CAST(sum(event_id) FILTER (event_type <> 'error') AS BIGINT) AS ids FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'error') > 0
 UNION ALL SELECT 'rejected', count(*), CAST(NULL AS BIGINT) FROM events WHERE event_type = 'error'""")
def s02(spark, folder):
    path = scratch_folder(spark, "log")
    line = F.to_json(F.struct(F.concat(F.lit("run-"), "user_id").alias("runId"), F.col("event_id").alias("requestId"), "event_type"))
    # Errors were cut off while they were written.
    cut = F.when(F.col("event_type") == "error", F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    T.table(spark, folder, "events").select(cut.alias("value")).write.text(path)
    rows, rejects = jsonl.read_jsonl(spark, path, "runId string, requestId bigint, event_type string")
    counted = rows.groupBy("runId").agg(F.count(F.lit(1)).alias("records"), F.sum("requestId").alias("ids"))
    return counted.unionByName(rejects.agg(F.lit("rejected").alias("runId"), F.count(F.lit(1)).alias("records"), F.lit(None).cast("bigint").alias("ids")))


@query("s04_append_redacted", """SELECT c_custkey, '[REDACTED]' AS password, 'Bearer [REDACTED] from ' || c_mktsegment AS note FROM customer""")
def s04(spark, folder):
    rows = T.table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("password"), F.concat(F.lit("Bearer "), F.regexp_replace("c_name", "[^A-Za-z0-9]", ""), F.lit(" from "), "c_mktsegment").alias("note"))
    path = scratch_folder(spark, "redacted")
    jsonl.append_jsonl(rows.filter("c_custkey % 2 = 0"), path)
    jsonl.append_jsonl(rows.filter("c_custkey % 2 = 1"), path)
    back, _ = jsonl.read_jsonl(spark, path, "c_custkey bigint, password string, note string")
    return back


@query("o06_longest_secret_first", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'is [REDACTED]' ELSE 'is ' || o_orderpriority END AS text FROM orders""")
def o06(spark, folder):
    masked = redact_text(F.concat(F.lit("is "), "o_orderpriority"), ("URGENT", "1-URGENT"))
    return T.table(spark, folder, "orders").select("o_orderkey", masked.alias("text"))


@query("f17_masked_names", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '{"[REDACTED]":"x [REDACTED]","list":["token","[REDACTED]"]}' ELSE '{"' || c_mktsegment || '":"x ' || c_mktsegment || '","list":["token","[REDACTED]"]}' END AS body FROM customer""")
def f17_names(spark, folder):
    body = F.concat(F.lit('{"'), F.col("c_mktsegment"), F.lit('":"x '), F.col("c_mktsegment"), F.lit('","list":["t\\u006fken","'), F.col("c_name"), F.lit('"]}'))
    return T.table(spark, folder, "customer").select("c_custkey", redact_json(body, ("BUILDING",), mask_names=True).alias("body"))


@query("f18_iso_forms", """SELECT event_id, CASE event_type WHEN 'view' THEN epoch_us(date_trunc('second', ts)) WHEN 'click' THEN epoch_us(date_trunc('hour', ts)) WHEN 'signup' THEN epoch_us(date_trunc('second', ts)) + 123456
 WHEN 'error' THEN NULL ELSE epoch_us(date_trunc('minute', ts)) - 7200000000 END AS micros FROM events""")
def f18(spark, folder):
    at = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    text = (F.when(kind == "view", F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")).when(kind == "click", F.date_format(at, "yyyy-MM-dd HH'Z'"))
            .when(kind == "signup", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.123456789+00:00'")).when(kind == "error", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm'+02'")))
    return T.table(spark, folder, "events").select("event_id", F.unix_micros(zoned_timestamp(text)).alias("micros"))


ODD = """WITH odd AS (SELECT 'run-' || user_id AS "runId", event_id, event_type, CASE event_type WHEN 'error' THEN CAST('NaN' AS DOUBLE) WHEN 'signup' THEN -value WHEN 'click' THEN CAST('Infinity' AS DOUBLE) ELSE value END AS v, value FROM events) """


def _odd(spark, folder):
    kind = F.col("event_type")
    value = (F.when(kind == "error", F.lit(float("nan"))).when(kind == "signup", -F.col("value")).when(kind == "click", F.lit(float("inf"))).otherwise(F.col("value")))
    return T.table(spark, folder, "events").select(F.concat(F.lit("run-"), "user_id").alias("runId"), "event_id", value.alias("latencyMs"))


@query("a12_latency_of_odd_values", ODD + """SELECT "runId", count(*) FILTER (good) AS count, avg(v) FILTER (good) AS mean, quantile_disc(v, 0.5) FILTER (good) AS p50, quantile_disc(v, 0.95) FILTER (good) AS p95,
 min(v) FILTER (good) AS min, max(v) FILTER (good) AS max FROM (SELECT *, event_type NOT IN ('error', 'click') AND v >= 0 AS good FROM odd) GROUP BY 1""")
def a12_odd(spark, folder):
    return M.latency(_odd(spark, folder))


@query("a12_latency_violations", ODD + """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'latency: must not be negative' ELSE 'latency: finite number required' END AS problem FROM odd
 WHERE event_type IN ('error', 'click') OR event_type = 'signup' AND v < 0""")
def a12_violations(spark, folder):
    return M.latency_violations(_odd(spark, folder), ["event_id"])


@query("t02_restart", """SELECT event_type, count(*) AS records, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def t02(spark, folder):
    """A log that arrives in two folders' worth, the second repeating a part of the first and with earlier times."""
    source, target, checkpoint = (scratch_folder(spark, n) for n in ("log", "ingest", "offsets"))
    rows = T.table(spark, folder, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("timestamp"))
    ddl = "event_id bigint, event_type string, timestamp timestamp"
    for arrived in (rows.filter("event_id % 3 > 0"), rows):
        arrived.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(source)
        stream, _ = jsonl.stream_jsonl(spark, source, ddl)
        I.ingest_unique(stream, ["event_id"], target, checkpoint).awaitTermination()
    return I.stored(spark, target).groupBy("event_type").agg(F.count(F.lit(1)).alias("records"), F.sum("event_id").alias("ids"))
