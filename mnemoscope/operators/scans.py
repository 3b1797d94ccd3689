"""Ordered computations over groups of any size: ranks, running sums, running maxima, lags.

A window over one group sorts that whole group in one task.  Here a group is cut into blocks of
consecutive rows, the window runs inside each block, and what earlier blocks contribute is carried
in from one small summary row per block.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.session import checkpointed

BLOCK = "_block"


def range_blocks(df, keys, order, parts=None):
    """Cut groups by sampled ranges of (keys, order), so that blocks are even whatever the skew.

    ``order`` must end in a unique column.  The cut is made durable, because a re-run of the sampling
    after a lost executor could move the boundaries.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return checkpointed(cut)


def position_blocks(df, position, size=65_536):
    """Cut groups by a dense integer position that the data already has: no shuffle, no checkpoint."""
    return df.withColumn(BLOCK, F.expr(f"`{position}` div {size}"))


def running(blocks, keys, order, rank=None, sums=None, maxes=None, lags=None, keep_blocks=False):
    """Add running columns over (keys ordered by ``order``) to a DataFrame that has blocks.

    rank: name of a 1-based row number; sums and maxes: {new column: input column}, both inclusive of
    the current row; lags: {new column: input column} of the previous row.  ``keep_blocks`` leaves the
    blocks in place for a further scan in the same order.
    """
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy(BLOCK)
    all_before = before.rowsBetween(W.unboundedPreceding, -1)

    totals = [F.count(F.lit(1)).alias("_n")]
    totals += [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    totals += [F.max(c).alias(f"_m_{n}") for n, c in maxes.items()]
    if lags:
        last = F.struct(*[F.col(c).alias(n) for n, c in lags.items()])
        totals.append(F.max_by(last, F.struct(*order)).alias("_last"))
    carried = [F.sum("_n").over(all_before).alias("_cn")]
    carried += [F.sum(f"_s_{n}").over(all_before).alias(f"_cs_{n}") for n in sums]
    carried += [F.max(f"_m_{n}").over(all_before).alias(f"_cm_{n}") for n in maxes]
    if lags:
        carried.append(F.lag("_last").over(before).alias("_clast"))
    carry = (blocks.groupBy(*keys, BLOCK).agg(*totals)
             .select(*keys, BLOCK, *carried).filter("_cn IS NOT NULL"))

    columns = [F.row_number().over(inside).alias("_rn")]
    columns += [F.sum(c).over(upto).alias(f"_rs_{n}") for n, c in sums.items()]
    columns += [F.max(c).over(upto).alias(f"_rm_{n}") for n, c in maxes.items()]
    if lags:
        columns.append(F.lag(F.struct(*[F.col(c).alias(n) for n, c in lags.items()])).over(inside).alias("_prev"))
    # A group fits in one block unless it is cut, so few rows have anything carried in.
    joined = blocks.select("*", *columns).join(carry, [*keys, BLOCK], "left")

    result = [c for c in blocks.columns if keep_blocks or c != BLOCK]
    out = [F.col(c) for c in result]
    if rank:
        out.append((F.col("_rn") + F.coalesce("_cn", F.lit(0))).alias(rank))
    out += [F.when(F.col(f"_rs_{n}").isNotNull() | F.col(f"_cs_{n}").isNotNull(),
                   F.coalesce(f"_rs_{n}", F.lit(0)) + F.coalesce(f"_cs_{n}", F.lit(0))).alias(n)
            for n in sums]
    out += [F.greatest(f"_rm_{n}", f"_cm_{n}").alias(n) for n in maxes]
    out += [F.when(F.col("_rn") > 1, F.col(f"_prev.{n}")).otherwise(F.col(f"_clast.{n}")).alias(n)
            for n in lags]
    return joined.select(*out)
