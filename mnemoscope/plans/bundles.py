"""Report bundles: one canonical document and one manifest for each run, published, verified and read back."""

from pyspark.sql import functions as F

from mnemoscope.functions import jsontype as J
from mnemoscope.functions.canonical import canonical_json
from mnemoscope.functions.ratio import holds
from mnemoscope.operators.curves import CURVE_FIELDS
from mnemoscope.quality.manifest_rules import FOOTPRINT_BYTES, FOOTPRINT_WARNING
from mnemoscope.quality.framework import all_of
from mnemoscope.sources import published as P

REPORT_VERSION = "report-1.0"
KEEP_NULLS = {"ignoreNullFields": "false"}


def _section(rows, name, part=None):
    """Rows with one row for each run as a part of its document: (runId, section, part, body)."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "runId"]), KEEP_NULLS)
    return rows.select("runId", F.lit(name).alias("section"), F.lit(part).cast("string").alias("part"), body.alias("body"))


def _object(name, body):
    """A JSON object of the (name, body) pairs of a group.  A name that occurs twice makes no valid JSON."""
    quoted = F.regexp_extract(F.to_json(F.array(F.coalesce(name, F.lit("null")))), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(quoted, F.lit(":"), body)), ","), F.lit("}"))


def _breakdown(rows):
    """Breakdown groups as one part for each run and dimension, an object from label to counts."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("runId", "dimension", "label")]), KEEP_NULLS)
    return rows.select("runId", "dimension", "label", body.alias("body")).groupBy("runId", "dimension").agg(
        _object(F.col("label"), F.col("body")).alias("body")).select(
        "runId", F.lit("breakdown").alias("section"), F.col("dimension").alias("part"), "body")


def report_documents(report):
    """(runId, report): the parts of a ``jobs.Report`` as one canonical JSON document for each run.

    Parts meet in one aggregation by run instead of a join for each.  A document holds a run's metrics and its
    breakdown groups, a number bounded by the labels of a corpus; per-probe rows stay tables.  Labels are in text
    order.  Parts that are None are left out.  A run that a part gives twice has NULL for a document.
    """
    named = [("accuracy", "accuracy", None), ("abstention", "abstention", None), ("tokens", "tokenEfficiency", "totals"),
             ("token_distribution", "tokenEfficiency", "assembledContextTokens"), ("relevance", "contextRelevance", None),
             ("operations", "operationalTelemetry", "counts"), ("request_latency", "operationalTelemetry", "requestLatencyMs"),
             ("probe_latency", "operationalTelemetry", "probeLatencyMs")]
    parts = [_section(getattr(report, field), section, part) for field, section, part in named if getattr(report, field) is not None]
    if report.breakdown is not None:
        parts.append(_breakdown(report.breakdown))
    rows = all_of(parts)
    whole = F.when(F.count("part") == 0, F.when(F.count(F.lit(1)) == 1, F.first("body"))).otherwise(_object(F.col("part"), F.col("body")))
    sections = rows.groupBy("runId", "section").agg(whole.alias("body"))
    # A section without a body would leave the list silently; as a broken part it makes the document NULL.
    sections = sections.withColumn("body", F.coalesce("body", F.lit("!")))
    version = F.lit(f'{{"schemaVersion":"{REPORT_VERSION}",')
    body = F.concat(version, F.substring(F.col("_all"), F.lit(2), F.length("_all")))
    return sections.groupBy("runId").agg(_object(F.col("section"), F.col("body")).alias("_all")).select(
        "runId", canonical_json(body).alias("report"))


def _bound(value, use):
    """``use`` of a value that is computed once: a lambda binds it, as every use of a column would compute it again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sized(fields, others, warnings):
    """(manifest of a size, total size) where the size counts the manifest's own bytes, digits included."""
    def text(size):
        return canonical_json(F.to_json(F.struct(*fields, F.array(*warnings).cast("array<string>").alias("warnings"),
                                                 size.alias("artifactSizeBytes")), KEEP_NULLS))

    def whole(without):
        fits = F.filter(F.sequence(F.lit(1), F.lit(19)), lambda d: F.length((without + d).cast("string")) == d)
        return (without + F.element_at(fits, 1)).cast("bigint")
    return text, _bound(others + F.octet_length(text(F.lit(0).cast("bigint"))) - 1, whole)


def bundles(documents, runs, artifacts=None):
    """(identity, runId, manifest, report): bundles named after the hash of their manifest.

    documents: from ``report_documents``; runs: runId and the fields that manifests carry (fixtureHash, scale,
    deterministic, arrival and the configuration); artifacts: runId, name, sha256, bytes of the run's other files.
    Where a document or a manifest is no valid JSON the identity is NULL.
    """
    rows = runs.join(documents, "runId")
    own = F.struct(F.sha2("report", 256).alias("sha256"), F.octet_length("report").cast("bigint").alias("bytes"))
    if artifacts is None:
        rows = rows.withColumns({"_files": F.lit(None).cast("string"), "_bytes": F.lit(0).cast("bigint")})
    else:
        files = artifacts.groupBy("runId").agg(_object(F.col("name"), F.to_json(F.struct(F.col("sha256").alias("h")))).alias("_files"),
                                               F.sum("bytes").alias("_bytes"))
        rows = rows.join(files, "runId", "left")
    named = F.from_json(F.coalesce("_files", F.lit("{}")), "map<string,struct<h:string>>")
    hashes = F.map_concat(F.transform_values(named, lambda _, v: v["h"]), F.create_map(F.lit("report.json"), F.col("_own.sha256")))
    rows = rows.withColumn("_own", own).withColumn("artifactHashes", hashes)
    fields = [F.lit(REPORT_VERSION).alias("schemaVersion"), F.col("artifactHashes"), *[F.col(c) for c in runs.columns]]
    others = F.col("_own.bytes") + F.coalesce("_bytes", F.lit(0))
    plain, size = _sized(fields, others, [])
    warned, larger = _sized(fields, others, [F.lit(FOOTPRINT_WARNING)])
    manifest = _bound(size, lambda n: F.when(n > FOOTPRINT_BYTES, _bound(larger, warned)).otherwise(plain(n)))
    rows = rows.withColumn("manifest", F.when(F.col("report").isNotNull(), manifest))
    return rows.select(F.sha2("manifest", 256).alias("identity"), "runId", "manifest", "report")


def publish_bundles(rows, path):
    """Publish bundles in two phases; returns (identity, reason) of those refused.  A bundle is one row, so an
    identity that comes twice is refused, and known ones are left as they are."""
    return P.publish_audited(rows, path, expected=1)


def checked_bundles(rows, artifacts=None):
    """Bundles with what is wrong about them: ``problems``, an empty list for sound ones, and ``_manifest`` and
    ``_report`` parsed.  Sizes count the other files' bytes where ``artifacts`` gives them."""
    rows = rows.withColumn("_manifest", J.strict(F.col("manifest"))).withColumn("_report", J.strict(F.col("report")))
    declared = J.at(F.col("_manifest"), "$.artifactHashes", "map<string,string>")
    rows = rows.withColumn("_declared", declared)
    if artifacts is None:
        rows = rows.withColumns({"_found": F.array().cast("array<struct<name:string,sha256:string>>"), "_bytes": F.lit(0).cast("bigint")})
    else:
        found = artifacts.groupBy("runId").agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("_found"), F.sum("bytes").alias("_bytes"))
        rows = rows.join(found, "runId", "left")
    others = F.array_sort(F.transform(F.map_entries(F.map_filter("_declared", lambda k, _: k != "report.json")),
                                      lambda e: F.struct(e["key"].alias("name"), e["value"].alias("sha256"))))
    none = F.array().cast("array<struct<name:string,sha256:string>>")
    size = F.octet_length("manifest") + F.octet_length("report") + F.coalesce("_bytes", F.lit(0))
    version = J.at(F.col("_manifest"), "$.schemaVersion", "string")
    checks = [
        (F.sha2("manifest", 256) == F.col("identity"), "bundle is not named after its manifest"),
        (F.sha2("report", 256) == F.try_element_at("_declared", F.lit("report.json")), "hash differs"),
        (others == F.coalesce("_found", none), "other files differ"),
        (size == J.at(F.col("_manifest"), "$.artifactSizeBytes", "bigint"), "total size differs"),
        ((version == REPORT_VERSION) & (J.at(F.col("_report"), "$.schemaVersion", "string") == REPORT_VERSION), "unknown schema version"),
    ]
    wrong = F.filter(F.array(*[F.when(~holds(fine), F.lit(text)) for fine, text in checks]), lambda p: p.isNotNull())
    return rows.withColumn("problems", wrong).drop("_declared", "_found", "_bytes")


def curve_reports(rows):
    """Sound bundles as the rows that ``jobs.compare_reports`` takes; others are left to their problems."""
    manifest, report = F.col("_manifest"), F.col("_report")
    settings = [F.to_json(J.at(manifest, f"$.{f}")).alias(f) for f in CURVE_FIELDS if f not in ("scale", "fixtureHash")]
    return rows.filter(F.size("problems") == 0).select(
        F.col("identity").alias("manifestHash"), "runId", J.at(manifest, "$.arrival", "bigint").alias("arrival"), J.at(manifest, "$.scale", "int").alias("scale"),
        J.at(manifest, "$.fixtureHash", "string").alias("fixtureHash"), J.at(manifest, "$.deterministic", "boolean").alias("deterministic"),
        *[J.at(report, f"$.accuracy.{c}", "bigint").alias(c) for c in ("correct", "answered", "total")], *settings)
