"""Token-bucket audit of a request stream, per provider, in whatever order its batches arrive."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.operators.scans import range_blocks, running
from mnemoscope.session import checkpointed
from mnemoscope.streaming.levels import Levels
from mnemoscope.streaming.writers import current_folder, set_current, started, writer_of

_BLOCK = ["provider", "block"]
_SUMMARY = "provider string, block bigint, n bigint, peak bigint, carry bigint, batch bigint"


def _newest(parts):
    rest = [c for c in parts.columns if c not in _BLOCK]
    return parts.groupBy(*_BLOCK).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*_BLOCK, *[F.col("x")[c].alias(c) for c in rest])


def _joined(rows, blocks, how, *columns):
    """Rows of these blocks; a null provider is one like the others."""
    right = blocks.select(F.col("provider").alias("_p"), F.col("block").alias("_b"), *columns)
    joined = rows.join(right, rows["provider"].eqNullSafe(right["_p"]) & (rows["block"] == right["_b"]), how)
    return joined.drop("_p", "_b")


def _ranked(requests, step):
    """Place of each request in its block, and the block's peak up to it."""
    order = [*_BLOCK, "t", "seq"]
    placed = running(range_blocks(requests, _BLOCK, ["t", "seq"]), _BLOCK, order, rank="place", keep_blocks=True)
    return running(placed.withColumn("lead", F.col("t") - (F.col("place") - 1) * step), _BLOCK, order, maxes={"peak": "lead"})


def _carried(summaries, step, length):
    """When the bucket is full again before each block, or null if that is no later than the block begins.

    A block of n requests turns the time x at which the bucket is full into max(x, peak) + n * step.  These
    functions are composed over a provider's blocks by one running sum and one running maximum.
    """
    before = W.partitionBy("provider").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    added = summaries.withColumn("_s", F.coalesce(F.sum("n").over(before), F.lit(0)) * step)
    full = added.withColumn("_x", F.max(F.col("peak") - F.col("_s")).over(before) + F.col("_s"))
    return full.withColumn("now", F.when(F.col("_x") > F.col("block") * length, F.col("_x"))).drop("_s", "_x")


def stream_rate_audit(requests, target, checkpoint, rpm=60, once=True, block_seconds=3600):
    """Keep the wait a token bucket would impose on each request of a stream: ``audited_waits`` reads them.

    requests: provider, seq, ts; seq tells requests of one time apart.  Requests are kept in blocks of time.  A block's
    effect on later ones is one (max, plus) function, so a batch, early or late, computes the waits of the blocks
    it falls into and of those later blocks of its providers that the bucket reaches differently now; where
    the bucket is full again, the repair ends.  A batch that is tried again replaces what it wrote; with a new
    checkpoint the audit begins anew.  Requests without a time have no wait.
    """
    spark = requests.sparkSession
    writer = writer_of(spark, checkpoint)
    set_current(spark, target, writer)
    step, length = int(60_000_000 / rpm), int(block_seconds * 1_000_000)
    burst = int((max(1, rpm) - 1) * step)

    def write(batch, number):
        spark, folder = batch.sparkSession, f"{target}/{writer}"
        t = F.unix_micros(F.col("ts").cast("timestamp"))
        rows = batch.select(F.col("provider").cast("string").alias("provider"), F.col("seq").cast("bigint").alias("seq"), t.alias("t"))
        rows.withColumn("block", F.floor(F.col("t") / length)).write.mode("overwrite").parquet(f"{folder}/requests/batch={number}")
        schema = "provider string, seq bigint, t bigint, block bigint, batch bigint"
        stored = spark.read.schema(schema).parquet(f"{folder}/requests").filter(F.col("batch") <= number)
        fresh = stored.filter(F.col("batch") == number)
        touched = fresh.filter("t IS NOT NULL").select(*_BLOCK).distinct()
        first = touched.agg(F.min("block")).first()[0]
        levels = Levels(spark, f"{folder}/blocks", _newest)
        known = levels.before(number, _SUMMARY)
        if first is None:
            waits, changed = fresh.limit(0), known.limit(0)
        else:
            # No wait before the earliest block of the batch can change: earlier rows are not read.
            later = stored.filter(F.col("block") >= first).drop("batch")
            summaries = (_ranked(_joined(later, touched, "left_semi"), step).groupBy(*_BLOCK)
                         .agg(F.count(F.lit(1)).alias("n"), F.max("lead").alias("peak")))
            all_blocks = (_joined(known.select(*_BLOCK, "n", "peak", "carry"), touched, "left_anti").withColumn("new", F.lit(False))
                          .unionByName(summaries.withColumn("carry", F.lit(None).cast("bigint")).withColumn("new", F.lit(True))))
            changed = checkpointed(_carried(all_blocks, step, length).filter(F.col("new") | ~F.col("now").eqNullSafe(F.col("carry")))
                                   .select(*_BLOCK, "n", "peak", F.col("now").alias("carry"), F.lit(number).cast("bigint").alias("batch")))
            waits = _ranked(_joined(later, changed, "inner", "carry"), step)
        wait = F.greatest(F.col("peak"), F.col("carry")) + (F.col("place") - 1) * step - burst - F.col("t")
        timed = (waits.select(*_BLOCK, "seq", F.greatest(wait, F.lit(0)).alias("waitMicros")) if first is not None
                 else fresh.limit(0).select(*_BLOCK, "seq", F.lit(0).cast("bigint").alias("waitMicros")))
        untimed = fresh.filter("t IS NULL").select(*_BLOCK, "seq", F.lit(None).cast("bigint").alias("waitMicros"))
        timed.unionByName(untimed).write.mode("overwrite").parquet(f"{folder}/waits/batch={number}")
        levels.add(changed.select("provider", "block", "n", "peak", "carry", "batch"), number)

    return started(requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def audited_waits(spark, target):
    """provider, seq, waitMicros of every request as of the last batch."""
    folder = current_folder(spark, target)
    levels = Levels(spark, f"{folder}/blocks", _newest)
    newest = levels.read().select(*_BLOCK, F.col("batch").alias("of_batch"))
    schema = "provider string, block bigint, seq bigint, waitMicros bigint, batch bigint"
    waits = spark.read.schema(schema).parquet(f"{folder}/waits").filter(F.col("batch") < levels.batches())
    same = waits["provider"].eqNullSafe(newest["provider"]) & (waits["block"] == newest["block"]) & (waits["batch"] == newest["of_batch"])
    timed = waits.filter("block IS NOT NULL").join(newest, same, "left_semi")
    return timed.unionByName(waits.filter("block IS NULL")).select("provider", "seq", "waitMicros")
