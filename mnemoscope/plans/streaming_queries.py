"""Streams over the event table, run to the end of what is there."""

from pyspark.sql import functions as F

from mnemoscope.plans.catalog import query
from mnemoscope.plans.metric_queries import VIEWS
from mnemoscope.session import scratch_folder
from mnemoscope.sources import tables as T
from mnemoscope.streaming import ingest as I
from mnemoscope.streaming import lifecycle as L
from mnemoscope.streaming import metrics as S
from mnemoscope.streaming import rate as R


def event_stream(spark, folder):
    schema = T.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _deliver(spark, parts, start):
    """Give a stream one part after the other; it stops and goes on from its checkpoint each time."""
    path = scratch_folder(spark, "deliveries")
    for part in parts:
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(part.schema).parquet(path)).awaitTermination()


def _parts(rows, key, n, repeated=None):
    """``n`` deliveries in no order of time; one in ``repeated`` rows comes with every delivery."""
    mixed = F.xxhash64(key)
    return [rows.filter((F.pmod(mixed, F.lit(n)) == i) | (F.pmod(mixed, F.lit(repeated)) == 0 if repeated else F.lit(False))) for i in range(n)]


@query("t01_ingest", """SELECT user_id AS "runId", event_type, count(*) AS records, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2""")
def t01(spark, folder):
    rows = event_stream(spark, folder).select(
        F.col("user_id").alias("runId"), F.col("event_id").alias("requestId"), "event_type", F.col("ts").cast("timestamp").alias("timestamp"))
    target, checkpoint = scratch_folder(spark, "ingest"), scratch_folder(spark, "offsets")
    # Every record arrives twice, as after a restart; the sink holds each once.
    twice = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    I.ingest_unique(twice, ["runId", "requestId"], target, checkpoint).awaitTermination()
    return I.stored(spark, target).groupBy("runId", "event_type").agg(
        F.count(F.lit(1)).alias("records"), F.sum("requestId").alias("ids"))


@query("t04_lost_checkpoint", """SELECT user_id AS "runId", count(*) AS records, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def t04(spark, folder):
    rows = T.table(spark, folder, "events").select(F.col("user_id").alias("runId"), F.col("event_id").alias("requestId"), "event_type")
    target, checkpoints = scratch_folder(spark, "ingest"), [scratch_folder(spark, "offsets") for _ in range(2)]
    # Four deliveries with repeated rows; after two of them the checkpoint is lost and the source is read from its beginning.
    number = iter(range(4))
    _deliver(spark, _parts(rows, "requestId", 4, 5), lambda stream: I.ingest_unique(stream, ["runId", "requestId"], target, checkpoints[next(number) // 2]))
    return I.stored(spark, target).groupBy("runId").agg(F.count(F.lit(1)).alias("records"), F.sum("requestId").alias("ids"))


COUNTERS = VIEWS + """ SELECT "runId", count(*) AS total, count(*) FILTER (status = 'ok') AS answered, count(*) FILTER (status = 'ok' AND k < 70) AS correct, CAST(sum("totalTokens") AS BIGINT) AS "totalTokens",
 count(*) FILTER (category = 'budget') AS budget, count(*) FILTER (category = 'provider') AS provider, count(*) FILTER (category = 'adapter') AS adapter, count(*) FILTER (category = 'timeout') AS timeout,
 CAST(count(*) FILTER (status = 'ok' AND k < 70) AS DOUBLE) / nullif(count(*) FILTER (status = 'ok'), 0) AS accuracy, CAST(count(*) FILTER (status = 'ok') AS DOUBLE) / count(*) AS "completionRate"
 FROM request GROUP BY "runId" """


def _outcomes(rows):
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return rows.select(
        F.concat(F.lit("run-"), F.col("user_id")).alias("runId"), (~failed).alias("eligible"), (~failed & (k < 70)).alias("correct"),
        (F.floor(F.col("value") * 100).cast("bigint") + 12).alias("totalTokens"),
        F.when(failed, F.when(k < 25, "budget").when(k < 50, "provider").when(k < 75, "adapter").otherwise("timeout")).alias("failureCategory"), "event_id")


@query("t08_incremental_metrics", COUNTERS)
def t08(spark, folder):
    target, checkpoint = scratch_folder(spark, "counters"), scratch_folder(spark, "offsets")
    S.maintain(_outcomes(event_stream(spark, folder)), target, checkpoint).awaitTermination()
    return S.with_rates(S.latest(spark, target))


@query("t08_corrected_metrics", COUNTERS)
def t08_corrected(spark, folder):
    rows = _outcomes(T.table(spark, folder, "events")).withColumn("change", F.lit(1))
    # Every fourth score comes wrong first; the last delivery takes it back and brings the right one.
    corrected = F.pmod("event_id", F.lit(4)) == 0
    wrong = rows.withColumn("correct", F.when(corrected, ~F.col("correct")).otherwise(F.col("correct"))).withColumn(
        "totalTokens", F.when(corrected, F.col("totalTokens") + 7).otherwise(F.col("totalTokens")))
    back = wrong.filter(corrected).withColumn("change", F.lit(-1)).unionByName(rows.filter(corrected))
    target, checkpoint = scratch_folder(spark, "counters"), scratch_folder(spark, "offsets")
    _deliver(spark, [*_parts(wrong, "event_id", 3), back], lambda stream: S.maintain(stream, target, checkpoint))
    return S.with_rates(S.latest(spark, target))


LIFECYCLE = VIEWS + """, e AS (SELECT "runId", seq AS position, ts, k, CASE event_type WHEN 'view' THEN 'run_started' WHEN 'signup' THEN 'session_completed' WHEN 'click' THEN 'interruption'
 WHEN 'error' THEN CASE WHEN k < 50 THEN 'run_completed' ELSE 'run_terminated' END ELSE 'turn' END AS type FROM request)
 SELECT "runId", arg_min(ts, position) FILTER (type = 'run_started') AS "startedAt", arg_max(ts, position) FILTER (type IN ('run_completed', 'run_terminated')) AS "endedAt",
 max(k) FILTER (type = 'session_completed') AS "lastCompletedSession", count(*) FILTER (type = 'interruption') AS interruptions,
 CASE arg_max(type, position) FILTER (type IN ('run_completed', 'run_terminated')) WHEN 'run_completed' THEN 'completed' WHEN 'run_terminated' THEN 'terminated'
 ELSE CASE WHEN count(*) FILTER (type = 'run_started') > 0 THEN 'running' ELSE 'unknown' END END AS status FROM e GROUP BY "runId" """


def _run_events(spark, folder):
    k = F.col("k")
    kind = (F.when(F.col("event_type") == "view", "run_started").when(F.col("event_type") == "signup", "session_completed")
            .when(F.col("event_type") == "click", "interruption")
            .when(F.col("event_type") == "error", F.when(k < 50, "run_completed").otherwise("run_terminated")).otherwise("turn"))
    return T.requests(spark, folder).select("runId", F.col("seq").alias("position"), "ts", kind.alias("type"), k.alias("sessionIndex"))


@query("t05_lifecycle", LIFECYCLE)
def t05(spark, folder):
    return L.lifecycle(_run_events(spark, folder))


@query("t05_stream", LIFECYCLE)
def t05_stream(spark, folder):
    rows = _run_events(spark, folder)
    target, checkpoint = scratch_folder(spark, "runs"), scratch_folder(spark, "offsets")
    # Three deliveries with late and repeated events; a year of silence ends no run here.
    _deliver(spark, _parts(rows, "position", 3, 5), lambda stream: L.stream_lifecycle(stream, target, checkpoint, silence_seconds=365 * 86_400))
    kind = rows.schema["ts"].dataType
    return L.current_lifecycle(spark, target).withColumns({c: F.col(c).cast(kind) for c in ("startedAt", "endedAt")})


def _probe_events(rows):
    """Every event starts a probe that takes value * 100 milliseconds; some never finish."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    finish = micros + F.floor(F.col("value") * 100).cast("bigint") * 1000
    both = F.when(F.col("event_type") == "signup", F.array(F.struct(F.lit("start").alias("type"), micros.alias("at")))).otherwise(
        F.array(F.struct(F.lit("start").alias("type"), micros.alias("at")), F.struct(F.lit("finish").alias("type"), finish.alias("at"))))
    return rows.select(F.concat(F.lit("run-"), F.col("user_id")).alias("runId"), F.col("event_id").cast("string").alias("probeId"), F.explode(both).alias("e")).select(
        "runId", "probeId", "e.type", F.timestamp_micros("e.at").alias("ts"))


@query("t06_deadlines", """WITH p AS (SELECT 'run-' || user_id AS "runId", CAST(event_id AS VARCHAR) AS "probeId", epoch_us(ts) AS s, CASE WHEN event_type <> 'signup' THEN CAST(floor(value * 100) AS BIGINT) END AS ms FROM events),
 f AS (SELECT "runId", min(s) AS e FROM p WHERE ms IS NULL OR ms > 20000 GROUP BY 1)
 SELECT "runId", "probeId", CASE WHEN s > e THEN 'unattempted' WHEN ms IS NULL OR ms > 20000 THEN 'timeout' ELSE 'ok' END AS outcome, CAST(ms AS DOUBLE) AS "latencyMs" FROM p LEFT JOIN f USING ("runId")""")
def t06(spark, folder):
    return L.deadlines(_probe_events(T.table(spark, folder, "events")), 20)


@query("t06_stream_deadlines", """WITH p AS (SELECT 'run-' || user_id AS "runId", CAST(event_id AS VARCHAR) AS "probeId", epoch_us(ts) AS s, CASE WHEN event_type <> 'signup' THEN CAST(floor(value * 100) AS BIGINT) END AS ms FROM events),
 c AS (SELECT max(s + coalesce(ms, 0) * 1000) AS clock FROM p),
 l AS (SELECT *, coalesce(ms > 20000, s + 20000000 < clock) AS late FROM p, c), f AS (SELECT "runId", min(s) AS e FROM l WHERE late GROUP BY 1)
 SELECT "runId", "probeId", CASE WHEN s > e THEN 'unattempted' WHEN late THEN 'timeout' WHEN ms IS NULL THEN 'open' ELSE 'ok' END AS outcome, CAST(ms AS DOUBLE) AS "latencyMs" FROM l LEFT JOIN f USING ("runId")""")
def t06_stream(spark, folder):
    target, checkpoint = scratch_folder(spark, "deadlines"), scratch_folder(spark, "offsets")
    L.stream_deadlines(_probe_events(event_stream(spark, folder)), target, checkpoint).awaitTermination()
    return L.judged_deadlines(spark, target, 20)


WAITS = """WITH p AS (SELECT event_type AS provider, event_id AS seq, epoch_us(ts) AS t, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
 SELECT provider, seq, greatest(max(t - (i - 1) * {step}) OVER (PARTITION BY provider ORDER BY t, seq) + (i - 1) * {step} - {burst} - t, 0) AS "waitMicros" FROM p"""


def _provider_requests(rows):
    return rows.select(F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), "ts")


@query("t07_stream_rate_audit", WAITS.format(step=600000000, burst=0))
def t07_stream(spark, folder):
    target, checkpoint = scratch_folder(spark, "waits"), scratch_folder(spark, "offsets")
    R.stream_rate_audit(_provider_requests(event_stream(spark, folder)), target, checkpoint, rpm=0.1).awaitTermination()
    return R.audited_waits(spark, target)


@query("t07_late_requests", WAITS.format(step=30000000, burst=30000000))
def t07_late(spark, folder):
    rows = _provider_requests(T.table(spark, folder, "events"))
    target, checkpoint = scratch_folder(spark, "waits"), scratch_folder(spark, "offsets")
    _deliver(spark, _parts(rows, "seq", 3), lambda stream: R.stream_rate_audit(stream, target, checkpoint, rpm=2, block_seconds=86_400))
    return R.audited_waits(spark, target)
