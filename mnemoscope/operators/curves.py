"""Degradation curves over session scales, repeat variance and comparability of runs."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.functions.canonical import struct_digest
from mnemoscope.functions.ratio import holds
from mnemoscope.operators.archive import duplicates
from mnemoscope.operators.scans import range_blocks, running

# Session scales, and the manifest fields of each identity.
SCALES = (10, 100, 500, 1000)
CURVE_FIELDS = ("adapter", "model", "tokenizer", "scorerVersion", "scorerHash", "judge",
                "calibrationHashes", "harnessHash", "seed", "fixtureSeed", "generatorVersion",
                "concurrency", "canonical")
COMPARABLE_FIELDS = ("fixtureHash", "harnessHash", "adapter", "model", "tokenizer", "scorerVersion",
                     "scorerHash", "judge", "calibrationHashes", "seed", "concurrency",
                     "nativeModelEnvelopeVersion")
SCORING_FIELDS = ("sourceManifestHash", "fixtureHash", "scorerVersion", "scorerHash", "judge",
                  "calibrationHashes", "canonical")
RUN_FIELDS = ("runId", "adapter", "model", "tokenizer", "stablePrefix", "seed", "scorerVersion",
              "harnessHash", "fixtureHash", "rateLimitRpm", "probeTimeoutSeconds",
              "nativeModelEnvelopeVersion")


def with_identity(manifests, fields, name):
    """Add the hash of an identity projection; fields a manifest lacks count as null."""
    columns = [F.col(f) if f in manifests.columns else F.lit(None).cast("string").alias(f) for f in fields]
    return manifests.withColumn(name, struct_digest(*columns))


def curve_points(reports, fields=CURVE_FIELDS):
    """Points (series, scale) of reports: manifestHash, scale, fixtureHash, deterministic, counts and
    rates, plus the configuration fields.  A configuration is a series."""
    return with_identity(reports, fields, "seriesId").filter(F.col("scale").isin(*SCALES))


def curve_violations(reports):
    """Scales outside the fixed set, and manifests that occur twice: a duplicate is not a repeat."""
    scale = reports.filter(~holds(F.col("scale").isin(*SCALES))).select(
        "manifestHash", F.lit("scale outside the four").alias("problem"))
    twice = duplicates(reports, ["manifestHash"]).select(
        "manifestHash", F.lit("the same artifact twice is no repeat").alias("problem"))
    return scale.unionByName(twice)


def repeat_index(points):
    """Number the runs of each (series, scale) in arrival order."""
    keys = ["seriesId", "scale"]
    return running(range_blocks(points, keys, ["arrival", "manifestHash"]), keys,
                   ["arrival", "manifestHash"], rank="repeat")


def missing_scales(points):
    """Scales a series has no point for."""
    seen = points.groupBy("seriesId").agg(*[
        F.max((F.col("scale") == s).cast("int")).alias(f"_{s}") for s in SCALES])
    gaps = F.filter(F.array(*[F.when(F.col(f"_{s}") == 0, F.lit(s)) for s in SCALES]), lambda s: s.isNotNull())
    return seen.select("seriesId", F.explode(gaps).alias("scale"))


def segments(points, metric):
    """Contiguous stretches of non-null values along the scales, per series and repeat.

    points: seriesId, repeat, scale, metric.  A line has four scales, a missing one being a gap.
    """
    lines = points.groupBy("seriesId", "repeat").pivot("scale", list(SCALES)).agg(F.max(metric))
    spine = lines.select("seriesId", "repeat", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.col(str(s)).alias("value")) for s in SCALES])).alias("p"))
    line = W.partitionBy("seriesId", "repeat").orderBy("scale")
    rows = spine.select("seriesId", "repeat", "p.scale", "p.value").withColumn(
        "segment", F.sum(F.col("value").isNull().cast("int")).over(line)).filter("value IS NOT NULL")
    start = F.row_number().over(W.partitionBy("seriesId", "repeat", "segment").orderBy("scale")) == 1
    return rows.withColumn("command", F.when(start, "M").otherwise("L"))


def repeat_variance(points, metrics=("accuracy", "completionRate")):
    """Population variance over repeats of a series, scale and fixture; NULL below two values.

    Runs of deterministic models are left out; an undeclared model counts as non-deterministic.  The
    values stay rows of ``points``: they are not gathered into a list.
    """
    rows = points.filter(~F.coalesce(F.col("deterministic"), F.lit(False)))
    aggregates = [F.count(F.lit(1)).alias("runs")]
    for m in metrics:
        aggregates += [F.count(m).alias(f"{m}Count"),
                       F.when(F.count(m) > 1, F.var_pop(m)).alias(f"{m}Variance")]
    return (rows.groupBy("seriesId", "scale", "fixtureHash").agg(*aggregates)
            .withColumn("status", F.when(F.col("runs") > 1, "reported").otherwise("not-reported")))


def comparability(manifests, pairs, fields=COMPARABLE_FIELDS):
    """Compare requested pairs of runs: which identity fields differ, and whether variance is needed.

    pairs: runA, runB.  manifests: runId, deterministic?, problem? (why a manifest is invalid, from
    the manifest rules) and the identity fields.  All runs of one configuration are found by
    ``with_identity`` without comparing pairs.
    """
    columns = [F.col(f) if f in manifests.columns else F.lit(None).cast("string").alias(f) for f in fields]
    problem = F.col("problem") if "problem" in manifests.columns else F.lit(None).cast("string")
    side = manifests.select("runId", F.struct(
        problem.alias("problem"), F.col("deterministic").alias("deterministic"), *columns).alias("m"))
    rows = (pairs.join(side.withColumnsRenamed({"runId": "runA", "m": "a"}), "runA", "left")
            .join(side.withColumnsRenamed({"runId": "runB", "m": "b"}), "runB", "left"))
    invalid = F.array(
        *[F.when(F.col(s).isNull() | F.col(f"{s}.problem").isNotNull(), F.concat(
            F.lit(f"manifest_{s}: "), F.coalesce(f"{s}.problem", F.lit("missing")))) for s in ("a", "b")])
    invalid = F.filter(invalid, lambda p: p.isNotNull())
    differ = F.filter(F.array(*[
        F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    mismatches = F.when(F.size(invalid) > 0, invalid).otherwise(differ)
    deterministic = holds(F.col("a.deterministic")) & holds(F.col("b.deterministic"))
    return rows.select("runA", "runB", (F.size(mismatches) == 0).alias("comparable"),
                       mismatches.alias("mismatches"), (~deterministic).alias("varianceRequired"))
