"""Run archives: request identities, links between probes and requests, token accounting, chronology.

All joins use (runId, id) or (runId, unit, position), which are unique, so a hot run spreads evenly.
"""

from pyspark.sql import functions as F

from mnemoscope.functions.canonical import struct_digest
from mnemoscope.functions.ratio import count_where, ratio
from mnemoscope.functions.tokens import TOKEN_BUDGET, count_tokens, over_budget
from mnemoscope.operators.joins import lookup_join
from mnemoscope.operators.scans import position_blocks, range_blocks, running

# Archive diagnostics that are not part of a request, and the fields that are.
ARCHIVE_FIELDS = ("status", "latencyMs", "attempts", "retryHistory", "waitSeconds", "providerTokens",
                  "modelVersion", "response", "answer", "category", "error", "sessionId", "turnId",
                  "probeId")
NATIVE_FIELDS = ("requestId", "messages", "tools", "toolCalls", "toolResults", "tierSegments", "model",
                 "decodingSettings", "seed")
RETRYABLE = (429, 503)
MAX_ATTEMPTS = 4
MAX_RETRY_WAIT = 30.0


def archived_request(rows):
    """Native and budget fields only, by naming what to keep."""
    return rows.select(*[c for c in rows.columns if c not in ARCHIVE_FIELDS])


def request_identity(rows, keys, name="identity"):
    """Hash of the native fields, segments without their claimed token counts."""
    fields = []
    for field in NATIVE_FIELDS:
        if field in rows.columns:
            column = F.col(field)
            if field == "tierSegments":
                column = F.transform(column, lambda s: s.dropFields("tokenCount"))
            fields.append(column.alias(field))
    return rows.select(*keys, struct_digest(*fields).alias(name))


def compact_identity(rows, name="hash"):
    """(runId, requestId, probeId, status, hash): all that linking needs, without message payloads."""
    places = ("sessionId", "probeId", "turnId")
    body = [c for c in rows.columns if c not in (*places, "runId")]
    return rows.select("runId", "requestId", "probeId", "status", struct_digest(*body).alias(name))


def linked_requests(probes, identities):
    """Each request a captured probe names, with what is wrong about the link or NULL.

    probes: runId, probeId, eligibleForAccuracy, requests array<struct<requestId, hash>>; identities:
    from ``compact_identity``.
    """
    named = probes.select("runId", "probeId", "eligibleForAccuracy",
                          F.posexplode("requests").alias("position", "r"))
    named = named.select("runId", "probeId", "eligibleForAccuracy", "position",
                         F.col("r.requestId").alias("requestId"), F.col("r.hash").alias("_claimed"))
    known = identities.select("runId", "requestId", F.col("probeId").alias("_owner"),
                              F.col("status").alias("_status"), "hash")
    rows = named.join(known, ["runId", "requestId"], "left")
    problem = (F.when(~F.coalesce(F.col("_owner") == F.col("probeId"), F.lit(False)),
                      "the archive has no such request of this probe")
               .when(~F.col("hash").eqNullSafe(F.col("_claimed")), "the copy of the request in the probe differs")
               .when(F.col("eligibleForAccuracy") & (F.col("_status") != "ok"),
                     "an answered probe holds a failed request"))
    return rows.select("runId", "probeId", "position", "requestId", problem.alias("problem"))


def positional_diff(left, right, keys, identity="identity"):
    """Compare two ordered lists per key: rows where one side is extra, missing or different.

    Both sides carry keys (run, unit and position) and an identity.
    """
    a = left.select(*keys, F.col(identity).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.col(identity).alias("_b"), F.lit(True).alias("_in_b"))
    problem = (F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra")
               .when(~F.col("_a").eqNullSafe(F.col("_b")), "differs"))
    return (a.join(b, keys, "full").withColumn("problem", problem)
            .filter("problem IS NOT NULL").select(*keys, "problem"))


def unknown_references(rows, targets, keys):
    """Rows whose reference has no target: turn to fact, probe to session, request to probe."""
    return rows.join(targets.select(*keys).distinct(), keys, "left_anti")


def coverage(expected, found, keys):
    """Ids that are expected but not found, and found but not expected."""
    missing = expected.select(*keys).join(found.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    surplus = found.select(*keys).join(expected.select(*keys), keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(surplus)


def duplicates(rows, keys):
    """Ids that occur more than once, with how often; counted before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def tier_tokens(requests, overhead="requestOverheadTokens"):
    """Tier sums and total of each request from its segments, plus whether it is over budget.

    The total is that of the whole wire body where ``wireTokens`` is given; segments count mapped
    fragments only, so the two need not agree.
    """
    def tier(name):
        mine = F.filter("tierSegments", lambda s: s["tier"] == name)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda total, s: total + s["tokenCount"])
    whole = F.col("wireTokens") if "wireTokens" in requests.columns else (
        tier("stable") + tier("semi-stable") + tier("unstable"))
    return (requests.withColumn("stable", tier("stable")).withColumn("semi_stable", tier("semi-stable"))
            .withColumn("unstable", tier("unstable")).withColumn("total", whole + F.col(overhead))
            .withColumn("overBudget", over_budget(F.col("total"))))


def attribute_tokens(segments, messages, tools, tokenizer="characters-smoke"):
    """Token count of a segment's mapped fragments: a compact JSON array of its messages and tools.

    segments: array<struct<.., messageIndices, toolNames>>; messages: array of wire JSON;
    tools: map from tool name to wire JSON.
    """
    def one(segment):
        none = F.array().cast("array<string>")
        mapped = F.transform(F.coalesce(segment["messageIndices"], F.array().cast("array<int>")),
                             lambda i: F.get(messages, i))
        named = F.transform(F.coalesce(segment["toolNames"], none), lambda name: F.try_element_at(tools, name))
        text = F.concat(F.lit("["), F.array_join(F.concat(mapped, named), ","), F.lit("]"))
        return segment.withField("tokenCount", count_tokens(text, tokenizer))
    return F.transform(segments, one)


def ordered_sources(requests_column):
    """Distinct source ids of a probe's nested requests, in order of first appearance."""
    none = F.array().cast("array<string>")
    per_request = F.transform(requests_column, lambda r: F.flatten(F.transform(
        r["tierSegments"], lambda s: F.coalesce(s["sourceIds"], none))))
    return F.array_distinct(F.flatten(per_request))


def tier_totals(requests, order="seq"):
    """Per-request token totals in archive order, one row per position.

    Kept as rows: as one array per run, a large run would be collected into one task.
    """
    blocks = range_blocks(requests.select("runId", "requestId", order, "totalTokens"), ["runId"], [order])
    return (running(blocks, ["runId"], [order], rank="position")
            .select("runId", "position", "requestId", "totalTokens"))


def context_growth(turns, budget=TOKEN_BUDGET, block=65_536):
    """Tokens of a request that re-sends all earlier turns of its run, and whether it is over budget.

    turns: runId, seq (dense from 0), tokens.  Runs are cut at fixed positions, so the running sum of
    a very long run is computed in parallel.
    """
    blocks = position_blocks(turns, "seq", block)
    grown = running(blocks, ["runId"], ["seq"], sums={"contextTokens": "tokens"})
    return grown.withColumn("overBudget", F.col("contextTokens") > budget)


def first_over_budget(growth):
    """Per run: turns, final context and the first turn whose context is over budget."""
    return growth.groupBy("runId").agg(
        F.count(F.lit(1)).alias("turns"), F.max("contextTokens").alias("finalTokens"),
        F.min(F.when(F.col("overBudget"), F.col("seq"))).alias("firstOverBudget"))


def prefix_changes(requests, order="seq"):
    """Requests whose stable prefix differs from the first one of their run."""
    first = requests.groupBy("runId").agg(F.min_by("stablePrefixHash", order).alias("_first"))
    rows = lookup_join(requests, first, ["runId"], spread=[order])
    return rows.filter(~F.col("stablePrefixHash").eqNullSafe(F.col("_first"))).drop("_first")


def retryable(status):
    """Provider statuses worth another attempt."""
    return F.coalesce(status.isin(*[str(s) for s in RETRYABLE]), F.lit(False))


def retry_audit(requests):
    """Retry policy of each request: attempts, back-off of 1, 2, 4 seconds, total retry wait.

    The history is an array inside each row; waits after the first attempt are retry waits.
    """
    history = F.col("retryHistory")
    waits = F.transform(history, lambda h: F.coalesce(h["backoffSeconds"], F.lit(0.0))
                        + F.coalesce(h["rateWaitSeconds"], F.lit(0.0)))
    total = F.aggregate(waits, F.lit(0.0), lambda a, b: a + b)
    backoff_ok = F.forall(F.transform(history, lambda h, i: F.struct(h["backoffSeconds"].alias("b"), i.alias("i"))),
                          lambda x: x["b"].isNull() | (x["b"] == F.pow(F.lit(2.0), x["i"].cast("double"))))
    last = F.size(history) - 1
    retried = F.transform(F.slice(history, 1, F.greatest(last, F.lit(0))), lambda h: h["status"])
    problem = (F.when(F.size(history) > MAX_ATTEMPTS, "more than four attempts")
               .when(~F.col("attempts").eqNullSafe(F.size(history)), "attempts differ from history")
               .when(~F.coalesce(backoff_ok, F.lit(True)), "back-off differs from 1, 2, 4 seconds")
               .when(total > MAX_RETRY_WAIT + 1e-9, "retry wait above 30 seconds")
               .when(F.exists(retried, lambda s: ~retryable(s)), "a final status was retried"))
    return requests.select("runId", "requestId", F.size(history).alias("attemptsMade"),
                           total.alias("retryWaitSeconds"), problem.alias("problem"))


def rate_audit(requests, rpm=60, time="ts", order="seq", earlier=None):
    """Wait a token bucket would impose on each request of a provider, in microseconds.

    The bucket holds max(1, rpm) tokens, starts full and refills at rpm / 60 per second.  The earliest
    time the bucket is full again obeys full(i) = max(full(i-1), t(i)) + step, so it equals
    (i+1) * step + max over j <= i of (t(j) - j * step): a rank and a running maximum, both of which
    split over blocks of one hot provider.

    ``earlier`` goes on from an audited log: provider, count and peak (the maximum above) of its requests.
    """
    step = int(60_000_000 / rpm)
    burst = int((max(1, rpm) - 1) * step)
    rows = requests.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    blocks = range_blocks(rows, ["provider"], [time, order])
    ranked = running(blocks, ["provider"], [time, order], rank="_i", keep_blocks=True)
    if earlier is not None:
        # One row per provider; Catalyst broadcasts it while it is small.
        carried = earlier.select("provider", F.col("count").alias("_before"), F.col("peak").alias("_peak0"))
        ranked = ranked.join(carried, "provider", "left").withColumn("_i", F.col("_i") + F.coalesce("_before", F.lit(0)))
    ranked = ranked.withColumn("_lead", F.col("_t") - (F.col("_i") - 1) * step)
    run = running(ranked, ["provider"], [time, order], maxes={"_peak": "_lead"})
    # The peak over earlier requests only matters when it beats the request's own time.
    peak = F.col("_peak") if earlier is None else F.greatest("_peak", "_peak0")
    wait = peak + (F.col("_i") - 1) * step - burst - F.col("_t")
    return (run.withColumn("waitMicros", F.greatest(wait, F.lit(0)))
            .select(*requests.columns, F.col("_i").alias("position"), "waitMicros"))


def telemetry_order(requests, unit_order, position, order="seq"):
    """Requests whose place in the run's list differs from their place when units are concatenated."""
    columns = requests.select("runId", "requestId", unit_order, position, order)
    by_log = running(range_blocks(columns, ["runId"], [order]), ["runId"], [order], rank="logPosition")
    by_unit = running(range_blocks(columns, ["runId"], [unit_order, position, order]), ["runId"],
                      [unit_order, position, order], rank="unitPosition")
    joined = by_log.join(by_unit.select("runId", "requestId", "unitPosition"), ["runId", "requestId"])
    return joined.filter("logPosition <> unitPosition").select("runId", "requestId", "logPosition", "unitPosition")


def run_timing(events, counts):
    """Elapsed seconds and request rate of each run, by log order: first start to last end event.

    events: runId, position, type, ts.  A run without an end has no duration; a zero duration has no
    rate.
    """
    starts = F.col("type").isin("run_started", "resume_restart")
    ends = F.col("type").isin("run_completed", "run_terminated")
    spans = events.groupBy("runId").agg(
        F.min_by(F.when(starts, F.col("ts")), F.when(starts, F.col("position"))).alias("startedAt"),
        F.max_by(F.when(ends, F.col("ts")), F.when(ends, F.col("position"))).alias("endedAt"),
        count_where(F.col("type").isin("interruption", "resume", "resume_restart")).alias("historyEvents"))
    elapsed = (F.unix_micros(F.col("endedAt").cast("timestamp"))
               - F.unix_micros(F.col("startedAt").cast("timestamp"))) / F.lit(1e6)
    return (spans.join(counts, "runId", "left")
            .withColumn("elapsedSeconds", F.when(elapsed >= 0, elapsed))
            .withColumn("requestsPerSecond", ratio(F.col("requestCount"), F.col("elapsedSeconds"))))


def discard_partial_sessions(records, resumes):
    """Drop records of sessions that an interrupted attempt did not complete.

    records: runId, attempt, sessionIndex, ...; resumes: runId, attempt, lastCompletedSession, where
    attempt n > 0 restarts after that session.  A record survives when no later attempt restarted at
    or before its session.
    """
    # Going down the attempts, each one asks for the lowest restart point seen among later ones.
    asked = records.select("runId", "attempt", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_point")).distinct()
    points = resumes.groupBy("runId", "attempt").agg(F.min("lastCompletedSession").alias("_point")).select(
        "runId", "attempt", F.lit(1).alias("_kind"), F.col("_point").cast("bigint"))
    rows = asked.unionByName(points).withColumn("_down", -F.col("attempt")).withColumn("_negative", -F.col("_point"))
    order = ["_down", "_kind"]
    lowest = running(range_blocks(rows, ["runId"], order), ["runId"], order, maxes={"_max": "_negative"})
    lowest = lowest.filter("_kind = 0").select("runId", "attempt", (-F.col("_max")).alias("_restart"))
    joined = lookup_join(records, lowest, ["runId", "attempt"], "left", spread=["sessionIndex"])
    return joined.filter("_restart IS NULL OR _restart >= sessionIndex").drop("_restart")
