import json
import random

from pyspark.sql import functions as F

from mnemoscope.sources import jsonl
from mnemoscope.streaming import ingest, lifecycle, metrics, rate

EVENT = "runId string, requestId string, timestamp timestamp, totalTokens bigint, eligible boolean, correct boolean, failureCategory string"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def record(i, **change):
    return {"runId": f"run{i % 2}", "requestId": f"r{i}", "timestamp": f"2026-01-01T00:00:{i:02d}Z", "totalTokens": 10 * i, "eligible": i % 3 > 0,
            "correct": i % 3 == 1, "failureCategory": None if i % 3 else "provider", **change}


def test_restart_continues_without_duplicates(spark, tmp_path):
    source, target, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")

    def run():
        rows, _ = jsonl.stream_jsonl(spark, str(source), EVENT)
        ingest.ingest_unique(rows, ["runId", "requestId"], target, offsets).awaitTermination()
    write(source, "a.jsonl", [record(i) for i in range(6)] + ["not an object"])
    run()
    # An interrupted writer sends two records again before going on.
    write(source, "b.jsonl", [record(i) for i in range(4, 9)])
    run()
    run()
    stored = ingest.stored(spark, target)
    assert sorted(r.requestId for r in stored.collect()) == sorted(f"r{i}" for i in range(9))


def test_incremental_counters_equal_batch(spark, tmp_path):
    source, target, offsets = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "offsets")
    for part in range(3):
        write(source, f"{part}.jsonl", [record(i) for i in range(part * 5, part * 5 + 5)])
        rows, _ = jsonl.stream_jsonl(spark, str(source), EVENT)
        metrics.maintain(rows, target, offsets).awaitTermination()
    batch, _ = jsonl.read_jsonl(spark, str(source), EVENT)
    got = sorted(map(tuple, metrics.with_rates(metrics.latest(spark, target)).collect()))
    assert got == sorted(map(tuple, metrics.with_rates(metrics.counters(batch)).collect())) and len(got) == 2


def test_redacted_stream_columns(spark):
    rows = spark.createDataFrame([("Bearer abc",)], "message string")
    assert ingest.redacted(rows, ["message"]).first().message == "Bearer [REDACTED]"


def test_lifecycle_follows_the_log(spark):
    rows = [("a", 1, "run_started", None), ("a", 2, "session_completed", 1), ("a", 3, "interruption", None), ("a", 4, "session_completed", 2), ("a", 5, "run_completed", None),
            ("b", 1, "run_started", None), ("b", 2, "session_completed", 1), ("c", 1, "run_started", None), ("c", 2, "run_completed", None), ("c", 3, "run_terminated", None)]
    events = spark.createDataFrame([(r, p, t, s) for r, p, t, s in rows], "runId string, position int, type string, sessionIndex int").withColumn(
        "ts", F.timestamp_seconds(F.col("position")))
    state = {r.runId: r for r in lifecycle.lifecycle(events).collect()}
    assert [(state[k].status, state[k].lastCompletedSession, state[k].interruptions) for k in "abc"] == [("completed", 2, 1), ("running", 1, 0), ("terminated", None, 0)]
    assert state["b"].endedAt is None


def test_deadlines_end_a_run(spark):
    rows = [("r", "p1", "start", 0), ("r", "p1", "finish", 5), ("r", "p2", "start", 10), ("r", "p2", "finish", 71), ("r", "p3", "start", 80), ("r", "p3", "finish", 81),
            ("s", "p1", "start", 0), ("s", "p1", "finish", 60), ("t", "p1", "start", 0)]
    events = spark.createDataFrame(rows, "runId string, probeId string, type string, at int").withColumn("ts", F.timestamp_seconds(F.col("at")))
    got = {(r.runId, r.probeId): r.outcome for r in lifecycle.deadlines(events, 60).collect()}
    assert got == {("r", "p1"): "ok", ("r", "p2"): "timeout", ("r", "p3"): "unattempted", ("s", "p1"): "ok", ("t", "p1"): "timeout"}


def bucket(times, rpm):
    """Waits by simulating the bucket request by request."""
    capacity, refill, tokens, clock, waits = max(1, rpm), rpm / 60, max(1, rpm), 0.0, []
    for t in times:
        now = max(t, clock)
        tokens = min(capacity, tokens + (now - clock) * refill)
        wait = max(0.0, now - t)
        if tokens < 1:
            more = (1 - tokens) / refill
            now, wait, tokens = now + more, wait + more, 1
        tokens, clock = tokens - 1, now
        waits.append(round(wait * 1e6))
    return waits


def test_rate_audit_equals_a_token_bucket(spark, tmp_path):
    from mnemoscope.operators.archive import rate_audit
    times = [0, 0, 0, 0, 1, 1, 30, 31, 31, 31, 31, 31, 200]
    for rpm in (3, 60):
        frame = spark.createDataFrame([("p", i, t) for i, t in enumerate(times)], "provider string, seq bigint, at bigint").withColumn("ts", F.timestamp_seconds(F.col("at")))
        got = [r.waitMicros for r in rate_audit(frame, rpm).orderBy("seq").collect()]
        assert got == bucket(times, rpm)


def test_streaming_rate_audit_keeps_its_state(spark, tmp_path):
    times = [0, 0, 0, 0, 1, 30, 31, 31, 31, 31]
    source, target, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    for part, cut in enumerate((slice(0, 5), slice(5, 10))):
        write(source, f"{part}.jsonl", [{"provider": "p", "seq": i, "at": times[i]} for i in range(10)[cut]])
        rows, _ = jsonl.stream_jsonl(spark, str(source), "provider string, seq bigint, at bigint")
        rate.stream_rate_audit(rows.withColumn("ts", F.timestamp_seconds("at")), target, offsets, rpm=3).awaitTermination()
    assert [r.waitMicros for r in rate.audited_waits(spark, target).orderBy("seq").collect()] == bucket(times, 3)


def test_late_records_are_kept_and_repeated_ones_dropped(spark, tmp_path):
    source, target, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    for i, at in enumerate(("12:00", "12:10", "10:00", "12:30", "10:00")):
        write(source, f"{i}.jsonl", [record(i % 4, timestamp=f"2026-01-01T{at}:00Z")])
        rows, _ = jsonl.stream_jsonl(spark, str(source), EVENT)
        ingest.ingest_unique(rows, ["runId", "requestId"], target, offsets).awaitTermination()
    assert sorted(r.requestId for r in spark.read.parquet(target).collect()) == ["r0", "r1", "r2", "r3"]


def test_stream_deadlines_judge_late_finishes_and_missing_ones(spark, tmp_path):
    source, target, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    batches = ([("p1", "start", 0), ("p2", "start", 0), ("p3", "start", 10)], [("p4", "start", 100_000), ("p5", "start", 99_999)],
               [("p1", "finish", 5), ("p5", "finish", 100_000), ("p2", "finish", 70)])
    for n, batch in enumerate(batches):
        write(source, f"{n}.jsonl", [{"runId": "r", "probeId": p, "type": t, "at": at} for p, t, at in batch])
        rows, _ = jsonl.stream_jsonl(spark, str(source), "runId string, probeId string, type string, at bigint")
        lifecycle.stream_deadlines(rows.withColumn("ts", F.timestamp_seconds("at")), target, offsets).awaitTermination()
    got = {r.probeId: (r.outcome, r.latencyMs) for r in lifecycle.judged_deadlines(spark, target, 60).collect()}
    # p1 and p2 start together, and p2 is the first to time out: what starts later is not attempted.
    assert got == {"p1": ("ok", 5000.0), "p2": ("timeout", 70000.0), "p3": ("unattempted", None), "p4": ("unattempted", None), "p5": ("unattempted", 1000.0)}


def test_batch_and_stream_deadlines_agree(spark, tmp_path):
    rng = random.Random(4)
    rows = [{"runId": f"r{rng.randrange(6)}", "probeId": f"p{rng.randrange(8)}", "type": rng.choice(("start", "finish", "finish")), "at": rng.randrange(300)} for _ in range(200)]
    rows += [{"runId": r, "probeId": "first", "type": "start", "at": 0} for r in ("r0", "r9")]
    source, target, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    for n in range(4):
        write(source, f"{n}.jsonl", rows[n::4])
        stream, _ = jsonl.stream_jsonl(spark, str(source), "runId string, probeId string, type string, at bigint")
        lifecycle.stream_deadlines(stream.withColumn("ts", F.timestamp_seconds("at")), target, offsets).awaitTermination()
    events = spark.createDataFrame([tuple(r.values()) for r in rows], "runId string, probeId string, type string, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    started = events.filter("type = 'start'").select("runId", "probeId").distinct()
    want = lifecycle.deadlines(events, 60).join(started, ["runId", "probeId"])
    got = lifecycle.judged_deadlines(spark, target, 60, ended=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.outcome for r in got.collect()} == {"ok", "timeout", "unattempted"}


def test_a_new_checkpoint_loses_and_doubles_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for part, rows, offsets in ((0, range(5), "one"), (1, range(3, 8), "two"), (2, range(6, 12), "two"), (3, [2, 12], "three")):
        write(source, f"{part}.jsonl", [record(i) for i in rows] + [record(50, runId=None)])
        stream, _ = jsonl.stream_jsonl(spark, str(source), EVENT)
        ingest.ingest_unique(stream, ["runId", "requestId"], target, str(tmp_path / offsets)).awaitTermination()
    assert sorted(r.requestId for r in ingest.stored(spark, target).collect()) == sorted(f"r{i}" for i in (*range(13), 50))


def test_a_retried_batch_replaces_itself_and_levels_stay_few(spark, tmp_path):
    from mnemoscope.streaming.levels import Levels
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    table, want = Levels(spark, str(tmp_path / "table"), total, fanout=3), {}
    for number in range(11):
        rows = [(i % 4, number) for i in range(number % 5)]
        frame = spark.createDataFrame(rows, "k int, n bigint")
        before = dict(map(tuple, table.before(number, frame.schema).collect()))
        table.add(frame, number)
        if number in (1, 2, 8):  # the driver stopped before the batch was noted, and tries it again
            assert dict(map(tuple, table.before(number, frame.schema).collect())) == before
            table.add(frame, number)
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        assert dict(map(tuple, table.read().collect())) == want and len(table.live(number + 1)) <= 6
    # What merges have consumed holds no rows any more.
    assert spark.read.parquet(str(tmp_path / "table" / "level-0" / "run-1")).count() == 0


def test_corrections_take_scores_back(spark, tmp_path):
    source, target, offsets = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "offsets")
    schema = EVENT + ", change int"
    parts = ([record(i, change=1) for i in range(6)], [record(4, change=-1), record(4, correct=False, change=1)], [record(i, change=-1) for i in (1, 3, 5)])
    for n, part in enumerate(parts):
        write(source, f"{n}.jsonl", part)
        rows, _ = jsonl.stream_jsonl(spark, str(source), schema)
        metrics.maintain(rows, target, offsets).awaitTermination()
    got = {r.runId: (r.total, r.answered, r.correct, r.provider, r.totalTokens) for r in metrics.latest(spark, target).collect()}
    assert got == {"run0": (3, 2, 0, 1, 60), "run1": (0, 0, 0, 0, 0)}


def test_late_requests_repair_later_blocks_only(spark, tmp_path):
    rng = random.Random(3)
    rows = [(p, i, rng.randrange(0, 4000) if i % 7 else 2000) for p in ("p", "q", None) for i in range(60)] + [("p", 900, None), ("idle", 1, 5)]
    source, target, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    order = rng.sample(rows, len(rows))
    for part in range(4):
        write(source, f"{part}.jsonl", [{"provider": p, "seq": i, "at": t} for p, i, t in order[part::4]])
        stream, _ = jsonl.stream_jsonl(spark, str(source), "provider string, seq bigint, at bigint")
        rate.stream_rate_audit(stream.withColumn("ts", F.timestamp_seconds("at")), target, offsets, rpm=3, block_seconds=300).awaitTermination()
    got = {(r.provider, r.seq): r.waitMicros for r in rate.audited_waits(spark, target).collect()}
    want = {("p", 900): None}
    for p in ("p", "q", None, "idle"):
        mine = sorted((t, i) for x, i, t in rows if x == p and t is not None)
        want |= {(p, i): w for (_, i), w in zip(mine, bucket([t for t, _ in mine], 3))}
    assert len(got) == len(rows) and all(abs(got[k] - want[k]) <= 1 if want[k] is not None else got[k] is None for k in want)
    # One more request near the end leaves the blocks before it alone.
    write(source, "9.jsonl", [{"provider": "q", "seq": 999, "at": 3999}])
    stream, _ = jsonl.stream_jsonl(spark, str(source), "provider string, seq bigint, at bigint")
    rate.stream_rate_audit(stream.withColumn("ts", F.timestamp_seconds("at")), target, offsets, rpm=3, block_seconds=300).awaitTermination()
    folder = rate.current_folder(spark, target)
    assert {(r.provider, r.block) for r in spark.read.parquet(f"{folder}/waits/batch=4").collect()} == {("q", 3999 // 300)}


def test_streamed_lifecycle_with_late_repeated_and_missing_events(spark, tmp_path):
    import time
    source, target, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    schema = "runId string, position bigint, type string, sessionIndex int"
    parts = ([("a", 3, "interruption", None), ("a", 2, "session_completed", 1), ("b", 1, "run_started", None), ("s", 1, "run_started", None)],
             [("a", 1, "run_started", None), ("a", 3, "interruption", None), ("a", 5, "run_completed", None), ("b", 7, "run_terminated", None), ("d", 4, "session_completed", 3)],
             [("a", 4, "session_completed", 2), ("a", 5, "run_completed", None), ("a", 3, "interruption", None), ("b", 6, "run_completed", None), ("d", 2, "interruption", None)])
    seen = []
    for n, part in enumerate(parts):
        write(source, f"{n}.jsonl", [dict(zip(("runId", "position", "type", "sessionIndex"), r)) for r in part])
        rows, _ = jsonl.stream_jsonl(spark, str(source), schema)
        events = rows.withColumn("ts", F.timestamp_seconds(F.col("position")))
        lifecycle.stream_lifecycle(events, target, offsets, silence_seconds=0.5 if n == 0 else 600).awaitTermination()
        seen.append({r.runId: r for r in lifecycle.current_lifecycle(spark, target).collect()})
        time.sleep(0.6)
    assert {k: r.status for k, r in seen[0].items()} == {"a": "unknown", "b": "running", "s": "running"}
    assert seen[1]["s"].status == "timed_out" and seen[2]["s"].endedAt is None
    assert {k: (r.status, r.lastCompletedSession, r.interruptions) for k, r in seen[2].items()} == {
        "a": ("completed", 2, 1), "b": ("terminated", None, 0), "s": ("timed_out", None, 0), "d": ("unknown", 3, 1)}
    flat = spark.createDataFrame(sorted({r for part in parts for r in part if r[0] != "s"}, key=repr), schema).withColumn("ts", F.timestamp_seconds(F.col("position")))
    columns = ["runId", "startedAt", "endedAt", "lastCompletedSession", "interruptions", "status"]
    want = sorted(map(tuple, lifecycle.lifecycle(flat).select(*columns).collect()))
    assert sorted(tuple(r) for k, r in seen[2].items() if k != "s") == want
