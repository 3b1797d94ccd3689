"""Incremental run counters: the additive part of the report, kept up to date by a stream."""

from pyspark.sql import functions as F

from mnemoscope.functions.ratio import ratio
from mnemoscope.operators.metrics import CATEGORIES
from mnemoscope.streaming.levels import Levels
from mnemoscope.streaming.writers import current_folder, set_current, started, writer_of


def counters(outcomes):
    """Answered, correct, failures and tokens per run; sums only, so batch equals stream.

    outcomes: runId, eligible, correct, failureCategory, totalTokens, and change if there are corrections: 1 adds
    an outcome, -1 takes one back (a score that is withdrawn or replaced).  Percentiles and variance need all
    values and stay in batch.
    """
    change = F.col("change").cast("bigint") if "change" in outcomes.columns else F.lit(1).cast("bigint")

    def where(condition):
        return F.sum(F.when(condition, change).otherwise(0))

    return outcomes.groupBy("runId").agg(
        F.sum(change).alias("total"), where(F.col("eligible")).alias("answered"), where(F.col("correct")).alias("correct"),
        F.sum(F.col("totalTokens") * change).alias("totalTokens"),
        *[where(F.col("failureCategory") == c).alias(c) for c in CATEGORIES])


def with_rates(counted):
    return (counted.withColumn("accuracy", ratio("correct", "answered"))
            .withColumn("completionRate", ratio("answered", "total")))


def _summed(parts):
    return parts.groupBy("runId").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "runId"])


def maintain(outcomes, target, checkpoint, once=True):
    """Keep the counters of every run: each batch of a stream of outcomes adds its own sums.

    Sums merge level by level, so neither a batch nor ``latest`` reads more than a few folders, and no state is held.  A
    batch that is tried again replaces what it wrote; with a new checkpoint the counters begin anew.  A run
    whose outcomes have all been taken back stays with zeros.
    """
    spark = outcomes.sparkSession
    writer = writer_of(spark, checkpoint)
    set_current(spark, target, writer)

    def write(batch, number):
        Levels(batch.sparkSession, f"{target}/{writer}", _summed).add(counters(batch), number)

    return started(outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def latest(spark, target):
    """The counters of each run after the last batch."""
    return Levels(spark, current_folder(spark, target), _summed).read()
