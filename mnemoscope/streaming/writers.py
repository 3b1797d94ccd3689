"""Who writes to the tables of a stream: an identity that lives and dies with the stream's checkpoint.

Batches are numbered from 0 by a checkpoint.  Tables are kept in a folder per writer, so a stream that starts
again with a new checkpoint never replaces what an earlier one has written.
"""

import uuid
from contextlib import contextmanager

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def writer_of(spark, checkpoint):
    """The name of the writer that a checkpoint belongs to, made when first asked for."""
    path = f"{checkpoint}/writer"
    for mode in ("ignore", "overwrite"):  # a crash may have left an empty folder
        spark.createDataFrame([(f"w{uuid.uuid4().hex}",)], "writer string").write.mode(mode).parquet(path)
        found = spark.read.schema("writer string").parquet(path).first()
        if found is not None:
            return found.writer
    raise RuntimeError(f"{path} holds no writer")


def set_current(spark, target, writer):
    """Name the writer whose tables under ``target`` readers take."""
    spark.createDataFrame([(writer,)], "writer string").write.mode("overwrite").parquet(f"{target}/current")


def current_folder(spark, target):
    return f"{target}/{spark.read.schema('writer string').parquet(f'{target}/current').first().writer}"


@contextmanager
def rocks_state(spark):
    """Queries started inside keep their state in RocksDB: on disk, in sorted runs with Bloom filters, so a batch
    reads its own keys' blocks and never the whole history.  Batches run when there is new data, so timers
    fire with the next batch after their time and a query that processes what is there comes to an end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def started(writer, once):
    """Start a stream: process what is there and stop, or keep running."""
    return writer.trigger(availableNow=True).start() if once else writer.start()
