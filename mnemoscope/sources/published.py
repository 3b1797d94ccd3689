"""Immutable tables published in two phases: rows are written and audited before an index names them.

A folder holds ``rows`` and ``index``, both in one subfolder for each attempt.  Readers see the rows of the
attempts that the index names, so an attempt that was killed leaves nothing visible, and the next one
starts afresh.  An identity belongs to one attempt for good: it is never replaced.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

INDEX = "identity string, rows bigint, checksum decimal(38,0), _attempt string"


def _index(spark, path):
    """Index rows; where two attempts ran at once, the first by name owns the identity."""
    try:
        rows = spark.read.schema(INDEX).parquet(f"{path}/index")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)
    first = F.min_by(F.struct("_attempt", "rows", "checksum"), "_attempt").alias("i")
    return rows.groupBy("identity").agg(first).select("identity", "i.*")


def identities(spark, path):
    """Published identities with the number and checksum of their rows and the attempt that wrote them."""
    return _index(spark, path)


def _summary(rows):
    """Number of rows and a sum of row hashes for each identity, whatever the order of rows."""
    columns = sorted(c for c in rows.columns if c not in ("identity", "_attempt"))
    return rows.groupBy("identity").agg(F.count(F.lit(1)).alias("rows"),
                                        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"))


def publish_audited(rows, path, expected=None):
    """Publish the rows of new identities and return the identities refused, with the reason.

    rows: identity and at least one other column; expected: how many rows every identity has, as a number or as
    a table of identity and rows.  Known identities are left as they are.  What is written is read again: an identity without the expected number of
    rows, or unexpected, stays invisible.  NULL identities are refused.  Rows of one identity are spread over
    files by their hash, so a large one is not one task's.
    """
    spark = rows.sparkSession
    attempt = f"a{uuid.uuid4().hex}"  # a letter first: no reader takes it for a number
    known = _index(spark, path).select("identity")
    fresh = rows.filter("identity IS NOT NULL").join(known, "identity", "left_anti")
    fresh.write.parquet(f"{path}/rows/_attempt={attempt}")
    written = spark.read.parquet(f"{path}/rows/_attempt={attempt}")
    found = _summary(written)
    problem = F.lit(None).cast("string")
    if isinstance(expected, int):
        problem = F.when(F.col("rows") != expected, "another number of rows than expected")
    elif expected is not None:
        wanted = expected.join(known, "identity", "left_anti").select("identity", F.col("rows").alias("_expected"))
        found = found.join(wanted, "identity", "full")
        problem = (F.when(F.col("rows").isNull(), "no rows were written").when(F.col("_expected").isNull(), "unexpected identity")
                   .when(F.col("rows") != F.col("_expected"), "another number of rows than expected"))
    judged = found.select("identity", "rows", "checksum", problem.alias("reason"))
    judged.filter("reason IS NULL").select("identity", "rows", "checksum", F.lit(attempt).alias("_attempt")).write.parquet(
        f"{path}/index/writer={attempt}")
    refused = judged.filter("reason IS NOT NULL").select("identity", "reason")
    nameless = rows.filter("identity IS NULL").select("identity", F.lit("no identity").alias("reason")).distinct()
    return refused.unionByName(nameless)


def published(spark, path):
    """All rows of published identities.  Rows of attempts that the index does not name stay unseen."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.join(_index(spark, path).select("identity", "_attempt"), ["identity", "_attempt"], "left_semi").drop("_attempt")


def damaged(spark, path):
    """Published identities whose rows are no longer those that the audit saw."""
    index = _index(spark, path).select("identity", F.struct("rows", "checksum").alias("_then"))
    now = _summary(published(spark, path)).select("identity", F.struct("rows", "checksum").alias("_now"))
    return index.join(now, "identity", "left").filter("NOT (_then <=> _now)").select("identity")
