"""Run lifecycle and probe deadlines, over batches and streams alike."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from mnemoscope.functions.ratio import count_where
from mnemoscope.operators.joins import lookup_join
from mnemoscope.streaming.levels import Levels
from mnemoscope.streaming.writers import current_folder, rocks_state, set_current, started, writer_of

STARTS, ENDS = ("run_started", "resume_restart"), ("run_completed", "run_terminated")


def lifecycle(events):
    """State of each run from its events: runId, position, ts, type, sessionIndex.

    A commutative aggregate that never holds a run's events.  A run without a final event has no duration.
    ``stream_lifecycle`` keeps the same for a stream, and ignores events that come twice.
    """
    def at(pick, *types):
        mine = F.col("type").isin(*types)
        return pick(F.when(mine, F.col("ts")), F.when(mine, F.col("position")))
    done = F.col("type") == "session_completed"
    rows = events.groupBy("runId").agg(
        at(F.min_by, *STARTS).alias("startedAt"),
        at(F.max_by, *ENDS).alias("endedAt"),
        F.max_by(F.when(F.col("type").isin(*ENDS), F.col("type")), F.when(F.col("type").isin(*ENDS), F.col("position"))).alias("_last"),
        F.max(F.when(done, F.col("sessionIndex"))).alias("lastCompletedSession"),
        count_where(F.col("type") == "interruption").alias("interruptions"))
    status = (F.when(F.col("_last") == "run_completed", "completed").when(F.col("_last") == "run_terminated", "terminated")
              .when(F.col("startedAt").isNotNull(), "running").otherwise("unknown"))
    return rows.withColumn("status", status).drop("_last")


class _Run(StatefulProcessor):
    """What is known of one run: a few numbers, and the positions of its interruptions so that each counts once."""

    FIELDS = ("startPosition", "startMicros", "endPosition", "endMicros", "endType", "lastCompletedSession", "interruptions", "version", "silent")
    STATE = ("startPosition bigint, startMicros bigint, endPosition bigint, endMicros bigint, endType string, "
             "lastCompletedSession bigint, interruptions bigint, version bigint, silent boolean")
    OUT = "runId string, startMicros bigint, endMicros bigint, lastCompletedSession bigint, interruptions bigint, status string, version bigint"

    def __init__(self, silence_ms):
        self.silence_ms = silence_ms

    def init(self, handle):
        self.handle = handle
        self.run = handle.getValueState("run", self.STATE)
        self.counted = handle.getMapState("counted", "position bigint", "seen boolean")

    def _known(self):
        found = self.run.get() if self.run.exists() else (None,) * 6 + (0, 0, False)
        return dict(zip(self.FIELDS, found))

    def _row(self, key, run):
        ended = {"run_completed": "completed", "run_terminated": "terminated"}.get(run["endType"])
        status = ended or ("timed_out" if run["silent"] else "running" if run["startPosition"] is not None else "unknown")
        self.run.update(tuple(run[f] for f in self.FIELDS))
        values = (key[0], run["startMicros"], run["endMicros"], run["lastCompletedSession"], run["interruptions"], status, run["version"])
        return pd.DataFrame({name.split()[0]: pd.Series([v], dtype="string" if name.endswith("string") else "Int64")
                             for name, v in zip(self.OUT.split(", "), values)})

    def handleInputRows(self, key, rows, timerValues):
        run = self._known()
        for frame in rows:
            for kind, position, micros, session in zip(frame["type"], frame["position"], frame["micros"], frame["sessionIndex"]):
                position, micros, session = (None if pd.isna(v) else int(v) for v in (position, micros, session))
                if position is None:
                    pass  # without a place an event can neither begin nor end a run
                elif kind in STARTS and (run["startPosition"] is None or position < run["startPosition"]):
                    run.update(startPosition=position, startMicros=micros)
                elif kind in ENDS and (run["endPosition"] is None or position > run["endPosition"]):
                    run.update(endPosition=position, endMicros=micros, endType=kind)
                elif kind == "interruption" and not self.counted.containsKey((position,)):
                    self.counted.updateValue((position,), (True,))
                    run["interruptions"] += 1
                if kind == "session_completed" and session is not None:
                    run["lastCompletedSession"] = max(session, run["lastCompletedSession"] or session)
        run.update(version=run["version"] + 1, silent=False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if run["endType"] is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield self._row(key, run)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        run = self._known()
        run.update(version=run["version"] + 1, silent=True)
        yield self._row(key, run)

    def close(self):
        pass


def _newest(parts):
    rest = [c for c in parts.columns if c != "runId"]
    return parts.groupBy("runId").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("runId", *[F.col("x")[c].alias(c) for c in rest])


def stream_lifecycle(events, target, checkpoint, silence_seconds, once=True):
    """Keep the state of every run of a stream of events: runId, position, ts, type, sessionIndex.

    Events may come late, in any order and repeatedly: position places them in their run.  A run without a final
    event from which nothing has been heard for ``silence_seconds`` of processing time is ``timed_out`` until it is heard
    again.  State and timers of a run are a few values in RocksDB; ``current_lifecycle`` reads all runs back.
    """
    spark = events.sparkSession
    writer = writer_of(spark, checkpoint)
    set_current(spark, target, writer)
    rows = events.select(F.col("runId").cast("string").alias("runId"), F.col("position").cast("bigint").alias("position"), "type",
                         F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("sessionIndex").cast("bigint").alias("sessionIndex"))
    states = rows.groupBy("runId").transformWithStateInPandas(
        statefulProcessor=_Run(int(silence_seconds * 1000)), outputStructType=_Run.OUT, outputMode="Update", timeMode="ProcessingTime")

    def write(batch, number):
        Levels(batch.sparkSession, f"{target}/{writer}", _newest).add(batch, number)

    with rocks_state(spark):
        return started(states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), once)


def current_lifecycle(spark, target):
    """The state of each run after the last batch, as ``lifecycle`` has it."""
    rows = Levels(spark, current_folder(spark, target), _newest).read()
    return rows.select("runId", F.timestamp_micros("startMicros").alias("startedAt"), F.timestamp_micros("endMicros").alias("endedAt"),
                       "lastCompletedSession", "interruptions", "status")


def _first_times(events):
    """When each probe started and first finished, in microseconds, and the latest time of any of its events."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy("runId", "probeId").agg(
        F.min(F.when(F.col("type") == "start", at)).alias("started"),
        F.min(F.when(F.col("type") == "finish", at)).alias("finished"), F.max(at).alias("latest"))


def _judged(probes, timeout_seconds, clock=None):
    """ok, timeout (finished late, or not by the deadline), open (the clock has not reached it), or unattempted: started
    after the first probe of its run that timed out.  Without a clock every deadline has passed."""
    limit = int(timeout_seconds * 1_000_000)
    took = F.col("finished") - F.col("started")
    passed = F.lit(True) if clock is None else F.col("started") + limit < F.lit(clock)
    late = F.when(F.col("finished").isNotNull(), F.coalesce(took > limit, F.lit(False))).otherwise(passed)
    probes = probes.withColumn("_late", late)
    first = probes.filter("_late").groupBy("runId").agg(F.min("started").alias("_ended"))
    rows = lookup_join(probes, first, ["runId"], "left", spread=["probeId"])
    outcome = (F.when(F.col("started") > F.col("_ended"), "unattempted").when(F.col("_late"), "timeout")
               .when(F.col("finished").isNull(), "open").otherwise("ok"))
    return rows.select("runId", "probeId", outcome.alias("outcome"), (took / 1000.0).alias("latencyMs"))


def deadlines(events, timeout_seconds):
    """Probes against their deadline, in batch: ok, timeout, or unattempted after the run's first timeout.

    events: runId, probeId, type ('start' | 'finish'), ts.  A probe that finishes several times counts with the
    first of them.
    """
    return _judged(_first_times(events), timeout_seconds)


def _earliest(parts):
    return parts.groupBy("runId", "probeId").agg(F.min("started").alias("started"), F.min("finished").alias("finished"), F.max("latest").alias("latest"))


def stream_deadlines(events, target, checkpoint, once=True):
    """Keep when each probe of a stream started and finished, as small tables that ``judged_deadlines`` merges.

    events: runId, probeId, type ('start' | 'finish'), ts.  Each batch is aggregated and replaces its own
    folder, so nothing is lost however late it comes, retries do no harm and no state is held.
    """
    spark = events.sparkSession
    writer = writer_of(spark, checkpoint)
    set_current(spark, target, writer)

    def write(batch, number):
        Levels(batch.sparkSession, f"{target}/{writer}", _earliest).add(_first_times(batch), number)

    return started(events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def judged_deadlines(spark, target, timeout_seconds, ended=False):
    """Every started probe of a stream's tables as of its latest event, by the rules of ``deadlines``; a probe whose deadline
    has not passed is open.  ended: the stream is over, so every deadline has passed and all is as in batch."""
    probes = Levels(spark, current_folder(spark, target), _earliest).read()
    clock = None if ended else probes.agg(F.max("latest")).first()[0]
    return _judged(probes.filter("started IS NOT NULL"), timeout_seconds, clock)
