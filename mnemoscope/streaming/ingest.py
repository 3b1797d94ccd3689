"""Continuous ingest of run logs into Parquet, exactly once across restarts."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoscope.functions.redact import redact_text
from mnemoscope.streaming.writers import rocks_state, started, writer_of


def redacted(rows, columns, secrets=()):
    """Mask credentials in the text columns of a stream."""
    return rows.withColumns({c: redact_text(F.col(c), secrets) for c in columns})


def ingest(rows, target, checkpoint, once=True):
    """Write a stream of log rows to Parquet; offsets live in the checkpoint, so a restart resumes.

    once: process what is there and stop, else keep running.
    """
    writer = (rows.writeStream.format("parquet").outputMode("append")
              .option("path", target).option("checkpointLocation", checkpoint))
    return started(writer, once)


def _of_others(spark, schema, target, writer):
    """What other writers have stored under ``target``, or None."""
    placed = T.StructType([*schema.fields, T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        others = spark.read.schema(placed).parquet(target).filter(F.col("writer") != writer)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if others.isEmpty() else others


def ingest_unique(rows, keys, target, checkpoint, once=True):
    """Write a stream of log rows to Parquet, one row for each value of ``keys``, however late it comes.

    Known keys are the stream's state: a batch looks up its own keys only, whatever has been stored before.  Null
    keys are equal.  Each batch goes to a folder of its own below one of its checkpoint's, ``writer=<name>/batch=<number>``,
    and replaces it when it is tried again.  If the checkpoint is lost, a new one reads its source again: rows that
    other writers have stored stay and are not stored twice.  ``stored`` reads the rows back.
    """
    spark = rows.sparkSession
    writer = writer_of(spark, checkpoint)
    others = _of_others(spark, rows.schema, target, writer)

    def write(batch, number):
        fresh = batch
        if others is not None:
            known = others.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
            fresh = batch.join(known, reduce(lambda x, y: x & y, [batch[k].eqNullSafe(known[f"_{i}"]) for i, k in enumerate(keys)]), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/writer={writer}/batch={number}")

    with rocks_state(spark):
        return started(rows.dropDuplicates(list(keys)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def stored(spark, target):
    """All rows that ``ingest_unique`` has written."""
    return spark.read.parquet(target).drop("writer", "batch")
