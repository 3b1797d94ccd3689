"""Joins to a side with one or few rows per key, where the other side may hold a hot key."""

from pyspark.sql import functions as F

SALTS = 64
HOT_SHARE = 1000  # a key with more than one in this many of all rows is hot


def estimated_bytes(df):
    """Catalyst's size estimate of a plan, an upper bound for scans and their aggregates."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df):
    """Whether the estimate is within the session's broadcast threshold."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= threshold


def hot_keys(rows, keys, share=HOT_SHARE):
    """Keys that hold more than 1 / share of all rows: fewer than ``share`` of them, whatever the data.

    Rows are counted per key before the shuffle.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(1))
    total = counts.groupBy("_all").agg(F.sum("_n").alias("_total"))
    return counts.join(total, "_all").filter(F.col("_n") * share > F.col("_total")).select(*keys, F.lit(True).alias("_hot"))


def lookup_join(rows, lookup, keys, how="inner", spread=None, salts=SALTS):
    """Join rows to a lookup by keys of which a few may hold a large part of all rows.

    A lookup within the session's broadcast threshold is left to Catalyst, which broadcasts it.  Beyond
    it the rows of hot keys are spread over ``salts`` tasks by the hash of ``spread`` (columns that vary
    inside a key) and only the lookup rows of hot keys are copied; all other keys join as they are.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep each row on its own side can be spread")
    if fits_broadcast(lookup) or not spread:
        return rows.join(lookup, keys, how)
    # Fewer than HOT_SHARE rows, so this may be broadcast.
    hot = F.broadcast(hot_keys(rows, keys))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int")
    spread_rows = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col("_hot"), salts - 1).otherwise(0)
    copies = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return spread_rows.join(copies, [*keys, "_salt"], how).drop("_salt")
