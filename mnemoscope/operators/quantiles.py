"""Exact nearest-rank distributions of groups of any size.

``percentile_disc`` keeps every distinct value of a group in one task.  Here the ranks are found by
counting: bins first, then only the rows of the bin that holds the wanted rank.  No raw row is
shuffled, only counts per bin.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.operators.joins import lookup_join

# Bins per unit of ln(1+|v|): relative width 0.1 %, at most 1.5 million bins over all doubles.
_COARSE = 1024
_FINE = 4096


def _pick(counts, keys, bins):
    """The bin in which each wanted rank falls, with the rank inside that bin."""
    upto = W.partitionBy(*keys).orderBy(*bins).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto))
    inside = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
    return ranked.filter(inside).withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n"))


def _pick_all(counts, keys, bins, probs):
    """The same for the first level, where every fraction has its rank in the whole group."""
    group = W.partitionBy(*keys)
    upto = group.orderBy(*bins).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("_total", F.sum("_n").over(group)).withColumn("_upto", F.sum("_n").over(upto))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.ceil(F.col("_total") * F.lit(float(p))).cast("bigint").alias("rank"))
                       for p in probs])
    here = F.filter(wanted, lambda x: (x["rank"] <= F.col("_upto")) & (x["rank"] > F.col("_upto") - F.col("_n")))
    return ranked.select("*", F.explode(here).alias("_w")).select(
        *counts.columns, "_w.prob", (F.col("_w.rank") - F.col("_upto") + F.col("_n")).alias("_rank"))


def _summarise(value):
    return (F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))


def nearest_rank(df, keys, value, probs):
    """keys + prob + quantile: the value at position ceil(count * prob) of each sorted group.

    ``probs`` is a short list of fractions.  NULL values are left out.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    rows = rows.withColumn("_b1", (F.signum(F.col("_v").cast("double"))
                                   * F.floor(F.log1p(F.abs(F.col("_v").cast("double"))) * _COARSE)))
    coarse = rows.groupBy(*keys, "_b1").agg(*_summarise("_v"))
    # Bins of one key are bounded, so the window over them is small.
    first = _pick_all(coarse, keys, ["_b1"], probs)
    first = first.select(*keys, "_b1", "prob", "_rank", "_lo", "_hi")
    settled = first.filter("_lo = _hi").select(*keys, "prob", F.col("_lo").alias("quantile"))
    open_bins = first.filter("_lo < _hi")

    span = (F.col("_hi") - F.col("_lo")).cast("double")
    fine_bin = F.floor((F.col("_v") - F.col("_lo")).cast("double") / span * _FINE)
    fine = (lookup_join(rows, open_bins, [*keys, "_b1"], spread=["_v"])
            .groupBy(*keys, "_b1", "prob", "_rank", fine_bin.alias("_b2")).agg(*_summarise("_v")))
    second = _pick(fine, [*keys, "prob"], ["_b2"]).select(*keys, "_b1", "prob", "_rank", "_lo", "_hi")
    settled = settled.unionByName(
        second.filter("_lo = _hi").select(*keys, "prob", F.col("_lo").alias("quantile")))

    left = second.filter("_lo < _hi")
    exact = (lookup_join(rows, left, [*keys, "_b1"], spread=["_v"]).filter("_v BETWEEN _lo AND _hi")
             .groupBy(*keys, "prob", "_rank", "_v").agg(F.count(F.lit(1)).alias("_n")))
    third = _pick(exact, [*keys, "prob"], ["_v"]).select(*keys, "prob", F.col("_v").alias("quantile"))
    return settled.unionByName(third)


def distribution(df, keys, value):
    """count, mean, p50, p95, min, max per group; groups come from all rows, so one without values
    has count 0 and NULL statistics.  NaN and infinite values count as none."""
    number = F.col(value).cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.col(value))
    df = df.withColumn(value, finite)
    finite = F.col(value)
    basic = df.groupBy(*keys).agg(
        F.count(finite).alias("count"), F.avg(finite).alias("mean"),
        F.min(finite).alias("min"), F.max(finite).alias("max"))
    picked = (nearest_rank(df, keys, value, (0.5, 0.95)).groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95")))
    return basic.join(picked, keys, "left").select(*keys, "count", "mean", "p50", "p95", "min", "max")
