"""Session settings the operators rely on, and the shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="mnemoscope", master=None, **conf):
    """A session with UTC timestamps and adaptive execution.

    On a cluster the master, memory and checkpoint folder come from the submit command; only
    semantics are set here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark, name):
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local session that names none, as in tests: on a cluster it
    would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        folder = tempfile.mkdtemp(prefix=f"mnemoscope-{name}-")
    return folder


def checkpointed(df):
    """Cut the lineage of ``df`` in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def scratch_folder(spark, name):
    """A fresh folder for tables a job writes and reads back, under the shared checkpoint folder."""
    return f"{_shared_folder(spark, 'scratch')}/{name}-{uuid.uuid4().hex}"


def materialized(df, name):
    """Write a table to the shared scratch folder and read it back: later readers scan only the columns
    they need, and nothing is computed again."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
