"""Rules M: run manifests and report manifests, as conditions over a table of JSON manifests."""

from pyspark.sql import functions as F

from mnemoscope.functions import jsontype as J
from mnemoscope.functions.canonical import archived_digest, projection_digest
from mnemoscope.functions.ratio import holds, ratio
from mnemoscope.functions.redact import redact_json
from mnemoscope.functions.text import blank, is_sha256, zoned_timestamp
from mnemoscope.operators.curves import RUN_FIELDS, SCORING_FIELDS
from mnemoscope.operators.metrics import CATEGORIES, INCOMPLETE, TIERS
from mnemoscope.quality.framework import all_of, flag, found

# Versions, required fields and policy bounds of manifests.
CONTRACT_VERSION = "2.0"
ENVELOPE_VERSION = "1.0"
REPORT_VERSION = "report-1.0"
ARTIFACTS = ("probes.jsonl", "requests.jsonl", "scores.jsonl", "report.json")
CALIBRATION_FILES = ("manifest.json", "probes.json", "review.json")
FOOTPRINT_BYTES = 5_000_000_000
FOOTPRINT_WARNING = "Artifact footprint exceeds 5GB; investigate telemetry storage."
REPORT_REQUIRED = (
    "schemaVersion", "runId", "adapter", "runtime", "model", "tokenizer", "stablePrefix", "stablePrefixHash",
    "seed", "timestamp", "harnessHash", "fixtureHash", "fixtureId", "fixtureSeed", "generatorVersion",
    "configHash", "rateLimitRpm", "probeTimeoutSeconds", "results", "recovery", "everyRequestTierTotals",
    "sourceManifestHash", "sourceScorerVersion", "scorerVersion", "scorerHash", "scoringHash", "judge",
    "canonical", "calibration", "calibrationHashes", "scoredAt", "sourceConfiguration", "sessionCount",
    "concurrency", "actualRunTimeSeconds", "nativeModelEnvelopeVersion",
    "effectiveThroughputRequestsPerSecond", "artifactSizeBytes", "interruptionResumeHistory",
    "providerVersionPinned", "artifactHashes", "warnings",
)


def missing_fields(manifest, required=REPORT_REQUIRED):
    """Required field names a manifest lacks."""
    return F.array_except(F.array(*[F.lit(f) for f in required]), J.keys(manifest))


def footprint_warnings(size):
    """Footprint is operational information, never an accuracy penalty."""
    return F.when(size > FOOTPRINT_BYTES, F.array(F.lit(FOOTPRINT_WARNING))).otherwise(F.array().cast("array<string>"))


class _Manifest:
    """Shorthand for typed access to a VARIANT manifest column."""

    def __init__(self, column):
        self.column = column

    def at(self, path, kind="variant"):
        return J.at(self.column, f"$.{path}", kind)

    def is_type(self, path, *kinds):
        return J.is_type(self.at(path), *kinds)

    def text(self, path):
        return self.is_type(path, "STRING") & ~blank(self.at(path, "string"))

    def number(self, path, positive=False):
        value = self.at(path, "double")
        return self.is_type(path, "INTEGER", "NUMBER") & ((value > 0) if positive else (value >= 0))

    def integer(self, path, minimum=0):
        return self.is_type(path, "INTEGER") & (self.at(path, "bigint") >= minimum)

    def sha256(self, path):
        return is_sha256(self.at(path, "string"))

    def stamp(self, path):
        return zoned_timestamp(self.at(path, "string")).isNotNull()

    def json(self, path):
        return F.to_json(self.at(path))

    def has(self, path):
        return self.at(path).isNotNull()


def _identity_rules(m):
    prefix = J.elements(m.column, "$.stablePrefix")
    return [
        ("M01", m.text("runId") & m.text("adapter.name") & m.text("adapter.revision"), "runId and adapter identity required"),
        ("M02", m.at("adapter.contractVersion", "string") == CONTRACT_VERSION, "adapter.contractVersion: required 2.0"),
        ("M03", m.is_type("model", "OBJECT") & m.is_type("tokenizer", "OBJECT"), "model and tokenizer: expected objects"),
        ("M04", (F.size(prefix) > 0) & F.forall(prefix, lambda p: J.is_type(p, "STRING")),
         "stablePrefix: expected nonempty list of strings"),
        ("M05", m.at("nativeModelEnvelopeVersion", "string") == ENVELOPE_VERSION, "nativeModelEnvelopeVersion: required 1.0"),
        ("M06", m.text("model.provider") & m.text("model.name") & m.text("model.version")
         & m.is_type("model.decoding", "OBJECT"), "model must be pinned"),
        ("M07", m.number("rateLimitRpm", True) & m.number("probeTimeoutSeconds", True),
         "rateLimitRpm, probeTimeoutSeconds: positive finite numbers required"),
        ("M08", m.stamp("timestamp"), "timestamp needs ISO form and a zone"),
    ]


def _concurrency(m):
    mode, factor = m.at("concurrency.mode", "string"), m.at("concurrency.factor", "bigint")
    return mode.isin("solo", "concurrent") & m.integer("concurrency.factor", 1) & ((mode != "solo") | (factor == 1))


def run_manifest_violations(manifests, fixtures):
    """Run manifests against their own rules and their fixture's identity.

    manifests: runId, text (JSON); fixtures: fixtureId, contentHash, generatorVersion, seed.
    """
    rows = manifests.withColumn("m", J.strict(F.col("text")))
    m = _Manifest(F.col("m"))
    rows = rows.withColumn("_fixture", m.at("fixtureId", "string"))
    known = fixtures.select(F.col("fixtureId").alias("_fixture"), F.struct("contentHash", "generatorVersion", "seed").alias("f"))
    rows = (rows.join(known, "_fixture", "left")
            .withColumn("_config", projection_digest((*RUN_FIELDS, "concurrency"))(F.col("text")))
            .withColumn("_prefix", archived_digest(F.concat(m.json("stablePrefix"), F.lit(""))))
            .withColumn("_clean", redact_json(F.col("text"))))
    return flag(rows, "runId", F.lit("manifest"), [
        ("M00", F.col("m").isNotNull(), "manifest: strict JSON required"),
        *_identity_rules(m),
        ("M09", m.text("harnessHash") & m.text("scorerVersion") & m.text("configHash") & m.text("fixtureHash")
         & m.text("stablePrefixHash"), "identity strings required"),
        ("M10", (m.at("fixtureHash", "string") == F.col("f.contentHash")), "fixture hash mismatch"),
        ("M11", (m.at("generatorVersion", "string") == F.col("f.generatorVersion"))
         & (m.at("fixtureSeed", "bigint") == F.col("f.seed")), "fixture version/seed mismatch"),
        ("M12", m.is_type("seed", "INTEGER"), "seed must be pinned"),
        ("M13", m.at("configHash", "string") == F.col("_config"), "configuration hash mismatch"),
        ("M14", m.at("stablePrefixHash", "string") == F.col("_prefix"), "stable prefix hash mismatch"),
        ("M15", ~m.has("concurrency") | _concurrency(m), "concurrency: solo/1 or concurrent/positive integer"),
        ("M16", F.to_json("m") == F.to_json(J.strict(F.col("_clean"))), "a credential stands in the manifest"),
    ])


def report_manifest_violations(manifests):
    """Report manifests: completeness, identities, accounting and hashes.

    manifests: runId, text (JSON).
    """
    rows = manifests.withColumn("m", J.strict(F.col("text")))
    m = _Manifest(F.col("m"))
    rows = (rows.withColumn("_scoring", projection_digest(SCORING_FIELDS)(F.col("text")))
            .withColumn("_source", archived_digest(m.json("sourceConfiguration")))
            .withColumn("_prefix", archived_digest(m.json("stablePrefix"))))
    results = _Manifest(m.at("results"))

    def n(path):
        return results.at(path, "bigint")
    failed = sum((n(f"failureCounts.{c}") for c in CATEGORIES), F.lit(0))
    incomplete = sum((n(f"failureCounts.{c}") for c in INCOMPLETE), F.lit(0))
    counted = ("requestCount", "totalCount", "answeredCount", "accuracyDenominator", "unattemptedCount",
               "incompleteCount", "lastCompletedSession", *[f"failureCounts.{c}" for c in CATEGORIES])
    counts_ok = F.lit(True)
    for path in counted:
        counts_ok = counts_ok & results.integer(path)
    elapsed, rate = m.at("actualRunTimeSeconds", "double"), m.at("effectiveThroughputRequestsPerSecond", "double")
    expected_rate = ratio(n("requestCount"), elapsed)
    close = F.abs(rate - expected_rate) <= F.greatest(1e-12 * F.greatest(F.abs(rate), F.abs(expected_rate)), F.lit(1e-12))
    rate_null = J.is_type(m.at("effectiveThroughputRequestsPerSecond"), "NULL")
    totals = J.elements(F.col("m"), "$.everyRequestTierTotals")
    ids = F.transform(totals, lambda t: J.at(t, "$.requestId", "string"))

    def total_ok(t):
        one = _Manifest(t)
        fine = one.text("requestId") & one.integer("totalTokens") & J.only_keys(one.at("tierTokens"), TIERS)
        for tier in TIERS:
            path = f"$.tierTokens['{tier}']"
            fine = fine & J.is_type(J.at(t, path), "INTEGER") & (J.at(t, path, "bigint") >= 0)
        return fine
    pinned, declared = m.json("providerVersionPinned"), F.coalesce(m.json("model.versionPinned"), F.lit("null"))
    history = J.elements(F.col("m"), "$.interruptionResumeHistory")

    def entry_ok(e):
        entry = _Manifest(e)
        kind = entry.at("type", "string")
        return F.when(kind == "recovery", entry.json("details") == m.json("recovery")).otherwise(
            kind.isin("interruption", "resume", "resume_restart") & entry.stamp("timestamp"))
    judge = _Manifest(m.at("judge"))
    named = F.lit(True)
    for key in ("provider", "model", "version", "rubricVersion", "endpoint", "keyEnv"):
        named = named & judge.text(key)
    off = judge.at("temperatureUnavailable", "boolean")
    judge_ok = (named & judge.is_type("temperatureUnavailable", "BOOLEAN") & judge.number("timeout", True)
                & F.when(off, ~judge.has("temperature")).otherwise(
                    judge.is_type("temperature", "INTEGER", "NUMBER") & (judge.at("temperature", "double") == 0))
                & (~judge.has("resolvedModel") | judge.text("resolvedModel")))
    config = m.at("sourceConfiguration", "map<string,variant>")
    source_keys = F.map_keys(config)
    full = F.size(F.array_except(F.array(*[F.lit(f) for f in RUN_FIELDS]), source_keys)) == 0
    no_more = F.size(F.array_except(source_keys, F.array(*[F.lit(f) for f in (*RUN_FIELDS, "concurrency")]))) == 0
    same_config = F.lit(True)
    for field in (*RUN_FIELDS, "concurrency"):
        own = m.json("sourceScorerVersion") if field == "scorerVersion" else m.json(field)
        theirs = F.to_json(config[field])
        if field == "model":
            # A model that does not say whether it is deterministic is published as null.
            theirs = F.when(m.has("sourceConfiguration.model.deterministic"), theirs)
            same_config = same_config & (theirs.isNull() | (theirs == own))
        else:
            same_config = same_config & (theirs.isNull() | (theirs == own))
    hashes_ok = m.sha256("calibrationHashes['manifest.json']")
    for name in CALIBRATION_FILES:
        hashes_ok = hashes_ok & m.sha256(f"calibrationHashes['{name}']")
    artifacts_ok = J.only_keys(m.at("artifactHashes"), ARTIFACTS)
    for name in ARTIFACTS:
        artifacts_ok = artifacts_ok & m.sha256(f"artifactHashes['{name}']")
    warnings = m.at("warnings", "array<string>")
    identity_hashes = F.lit(True)
    for key in ("fixtureHash", "harnessHash", "configHash", "stablePrefixHash", "sourceManifestHash", "scorerHash", "scoringHash"):
        identity_hashes = identity_hashes & m.sha256(key)
    return flag(rows, "runId", F.lit("report"), [
        ("M00", F.col("m").isNotNull(), "manifest: strict JSON required"),
        ("M20", F.size(missing_fields(F.col("m"))) == 0, "report manifest missing fields"),
        *_identity_rules(m),
        ("M21", m.at("schemaVersion", "string") == REPORT_VERSION, "another report version"),
        ("M22", m.text("fixtureId") & m.text("generatorVersion") & m.text("scorerVersion") & m.text("sourceScorerVersion"),
         "identity strings required"),
        ("M23", identity_hashes, "SHA-256 required"),
        ("M24", m.stamp("scoredAt"), "scoredAt: ISO timestamp with timezone required"),
        ("M25", m.is_type("seed", "INTEGER") & m.is_type("fixtureSeed", "INTEGER") & m.integer("sessionCount", 1),
         "seed, fixtureSeed, sessionCount: integers required"),
        ("M26", J.only_keys(m.at("runtime"), ("name", "revision")) & (m.json("runtime.name") == m.json("adapter.name"))
         & (m.json("runtime.revision") == m.json("adapter.revision")), "runtime is not the adapter"),
        ("M27", m.text("tokenizer.name") & m.text("tokenizer.version")
         & (~m.has("tokenizer.requestOverheadTokens") | m.integer("tokenizer.requestOverheadTokens")), "tokenizer"),
        ("M28", m.is_type("model.deterministic", "BOOLEAN", "NULL"), "model.deterministic: boolean or null required"),
        ("M29", m.is_type("providerVersionPinned", "BOOLEAN", "NULL") & (pinned == declared),
         "pinning differs from the model's own statement"),
        ("M30", _concurrency(m), "concurrency: solo/1 or concurrent/positive integer"),
        ("M31", holds(full) & holds(no_more), "the copied run configuration has other fields"),
        ("M32", m.at("configHash", "string") == F.col("_source"), "configHash is not that of the copied configuration"),
        ("M33", same_config, "report and copied configuration disagree"),
        ("M34", m.at("stablePrefixHash", "string") == F.col("_prefix"), "stablePrefixHash mismatch"),
        ("M35", results.at("status", "string").isin("completed", "terminated"), "results carry no final status"),
        ("M36", counts_ok & results.is_type("valid", "BOOLEAN") & results.is_type("investigationRequired", "BOOLEAN"),
         "results: counts and flags required"),
        ("M37", (n("answeredCount") + n("unattemptedCount") <= n("totalCount"))
         & (n("accuracyDenominator") == n("answeredCount")), "probe counts do not add up"),
        ("M38", n("lastCompletedSession") <= m.at("sessionCount", "bigint"), "more sessions completed than there are"),
        ("M39", (failed + n("answeredCount") + n("unattemptedCount") == n("totalCount"))
         & (n("incompleteCount") == incomplete), "failures do not add up"),
        ("M40", results.at("completionRate", "double") == F.coalesce(ratio(n("answeredCount"), n("totalCount")), F.lit(1.0)),
         "completionRate is not answered over total"),
        ("M41", results.at("investigationRequired", "boolean") == F.coalesce(
            ratio(n("incompleteCount"), n("totalCount")) > 0.05, F.lit(False)), "investigationRequired does not follow from the rate"),
        ("M42", (F.size(totals) == n("requestCount")) & F.forall(totals, total_ok)
         & (F.size(F.array_distinct(ids)) == F.size(ids)), "everyRequestTierTotals"),
        ("M43", m.number("actualRunTimeSeconds") & F.when(elapsed == 0, rate_null).otherwise(close),
         "throughput is not requests over seconds"),
        ("M44", m.integer("artifactSizeBytes") & (warnings == footprint_warnings(m.at("artifactSizeBytes", "bigint"))),
         "warnings do not follow from the size"),
        ("M45", m.is_type("recovery.resumed", "BOOLEAN") & m.integer("recovery.checkpointSession")
         & m.integer("recovery.nextSession") & (~m.has("recovery.interruption") | m.stamp("recovery.interruption.timestamp")),
         "recovery metadata"),
        ("M46", F.forall(history, entry_ok), "interruptionResumeHistory"),
        ("M47", m.is_type("canonical", "BOOLEAN"), "canonical: boolean required"),
        ("M48", J.only_keys(m.at("calibrationHashes"), CALIBRATION_FILES) & hashes_ok, "hashes of the three calibration files"),
        ("M49", m.at("calibration.approved", "boolean") & (m.json("calibration.calibrationHashes") == m.json("calibrationHashes"))
         & (m.json("calibration.scorerVersion") == m.json("scorerVersion")), "calibration identity mismatch"),
        ("M50", m.is_type("judge", "NULL") | judge_ok, "judge is neither null nor fully pinned"),
        ("M51", m.at("scoringHash", "string") == F.col("_scoring"), "scoringHash mismatch"),
        ("M52", artifacts_ok, "hashes of the four artifacts"),
    ])


def count_violations(manifests, counts):
    """Counts a run manifest declares against those of its archive.

    Both sides: runId, totalCount, answeredCount, unattemptedCount, requestCount.
    """
    names = ("totalCount", "answeredCount", "unattemptedCount", "requestCount")
    actual = counts.select("runId", F.struct(*names).alias("_actual"))
    declared = manifests.select("runId", F.struct(*names).alias("_declared"))
    rows = declared.join(actual, "runId", "left")
    return all_of([found(rows.filter(~F.col(f"_actual.{c}").eqNullSafe(F.col(f"_declared.{c}"))), "runId",
                         F.lit(c), "R13", "declared and archived counts differ") for c in names])
