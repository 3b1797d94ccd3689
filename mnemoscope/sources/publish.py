"""Immutable publication under content identities, and verification of published bundles."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mnemoscope.operators.archive import coverage
from mnemoscope.quality.manifest_rules import footprint_warnings


def published_identities(spark, path):
    """Identities already present; an empty table where nothing has been published.

    Identities are partition values, so no data file is read; as text, so that leading zeros stay.
    """
    try:
        return spark.read.schema("identity string").parquet(path).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "identity string")


def unpublished(rows, published):
    """Rows whose identity is not published yet: existing identities are never replaced."""
    return rows.join(published, "identity", "left_anti")


def publish(rows, path):
    """Append the rows of new identities, one folder per identity; returns nothing for known ones.

    A writer commits whole jobs, so a lost executor leaves no half-written identity behind.
    """
    spark = rows.sparkSession
    fresh = unpublished(rows, published_identities(spark, path))
    # Rows of one identity are few or many: the second key spreads a large one over several files.
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "identity"]), F.lit(32))
    fresh.repartition("identity", spread).write.mode("append").partitionBy("identity").parquet(path)


def bundle_files(spark, root):
    """Files of bundles under root/<bundle>/: bundle, name, bytes and SHA-256, hashed where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("bundle"), F.element_at(parts, -1).alias("name"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_bundles(files, manifests):
    """Problems of published bundles.

    files: from ``bundle_files``; manifests: bundle, manifestHash, artifactHashes map, artifactSizeBytes.
    A bundle is named after its manifest's hash and holds exactly the declared files.
    """
    declared = manifests.select("bundle", F.explode("artifactHashes").alias("name", "declared"))
    data = files.filter("name <> 'manifest.json'")
    both = declared.join(data, ["bundle", "name"])
    changed = both.filter("declared <> sha256").select("bundle", "name", F.lit("hash differs").alias("problem"))
    missing = coverage(declared, data, ["bundle", "name"])
    sizes = files.groupBy("bundle").agg(F.sum("bytes").alias("_bytes"))
    own = files.filter("name = 'manifest.json'").select("bundle", F.col("sha256").alias("_manifest"))
    rows = manifests.join(sizes, "bundle", "left").join(own, "bundle", "left")
    wrong_name = rows.filter("NOT (bundle <=> manifestHash) OR NOT (_manifest <=> manifestHash)").select(
        "bundle", F.lit("manifest.json").alias("name"), F.lit("bundle is not named after its manifest").alias("problem"))
    wrong_size = rows.filter("NOT (_bytes <=> artifactSizeBytes)").select(
        "bundle", F.lit("*").alias("name"), F.lit("total size differs").alias("problem"))
    return changed.unionByName(missing).unionByName(wrong_name).unionByName(wrong_size)


def footprint(files):
    """Bytes per bundle and the warning above five billion."""
    return (files.groupBy("bundle").agg(F.sum("bytes").alias("artifactSizeBytes"))
            .withColumn("warnings", footprint_warnings(F.col("artifactSizeBytes"))))


def file_set_hash(files):
    """One hash per bundle over its files in name order: a hash of (name, hash) pairs.

    The number of files in a code bundle bounds the list.
    """
    pair = F.concat("name", F.lit("\0"), "sha256")
    return files.groupBy("bundle").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256).alias("setHash"))


def write_canonical(rows, path):
    """Write rows as JSON text with sorted keys, one per line."""
    body = F.to_json(F.try_parse_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})))
    rows.select(body.alias("value")).write.mode("errorifexists").text(path)
