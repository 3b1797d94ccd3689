"""Calibration corpora on disk: three strict JSON documents per folder, with their file hashes."""

from pyspark.sql import functions as F

from mnemoscope import schemas
from mnemoscope.functions import jsontype as J

ROW = f"""struct<probeId:string, ability:string, question:string, candidateAnswer:string,
 expected:{schemas.EXPECTED}, goldJudgment:string, justification:string, answerability:boolean,
 answerAsOf:string, afterSessionIndex:int, edgeCases:array<string>,
 evidence:array<struct<factId:string, sessionIndex:int, text:string, state:string>>>"""
REVIEW = """struct<probeId:string, confirmedGoldJudgment:string, justificationConsistent:boolean,
 evidenceConsistent:boolean, reviewNote:string>"""


def read_corpora(spark, root):
    """(headers, rows, reviews) of all folders under root; documents that are no strict JSON are left
    out and show as missing headers."""
    files = spark.read.text(f"{root}/*/*.json", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    files = files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "value",
                         F.sha2("value", 256).alias("sha256")).withColumn("v", J.strict(F.col("value"))).filter("v IS NOT NULL")
    by_name = {n: files.filter(F.col("name") == n) for n in ("manifest.json", "probes.json", "review.json")}

    def field(path, kind="string"):
        return J.at(F.col("v"), f"$.{path}", kind)
    manifest = by_name["manifest.json"].select(
        "folder", field("schemaVersion").alias("manifestSchemaVersion"), field("calibrationSetId").alias("manifestSetId"),
        field("calibrationSetVersion").alias("manifestSetVersion"), field("retainedWithScorerVersion").alias("retainedWithScorerVersion"),
        field("frozenAt").alias("frozenAt"), field("requiredAgreement", "double").alias("requiredAgreement"),
        field("files['probes.json']").alias("declaredProbesHash"), field("files['review.json']").alias("declaredReviewHash"))
    probes = by_name["probes.json"].select(
        "folder", field("calibrationSetId").alias("calibrationSetId"), field("schemaVersion").alias("schemaVersion"),
        field("calibrationSetVersion").alias("calibrationSetVersion"), field("frozen", "boolean").alias("frozen"),
        field("labelingMethod").alias("labelingMethod"), F.col("sha256").alias("probesHash"),
        field("labelProvenance.kind").alias("labelKind"), field("labelProvenance.labelerId").alias("labelerId"))
    review = by_name["review.json"].select(
        "folder", field("calibrationSetId").alias("reviewSetId"), field("probesSha256").alias("reviewProbesHash"),
        field("reviewedAt").alias("reviewedAt"), field("reviewMethod").alias("reviewMethod"), field("result").alias("result"),
        F.col("sha256").alias("reviewHash"), field("reviewProvenance.kind").alias("reviewKind"),
        field("reviewProvenance.reviewerId").alias("reviewerId"))
    headers = probes.join(manifest, "folder", "left").join(review, "folder", "left")
    rows = by_name["probes.json"].select(
        field("calibrationSetId").alias("calibrationSetId"),
        F.explode(F.from_json("value", schemas.struct(f"probes array<{ROW}>"))["probes"]).alias("r")).select("calibrationSetId", "r.*")
    reviews = by_name["review.json"].select(
        field("calibrationSetId").alias("calibrationSetId"),
        F.explode(F.from_json("value", schemas.struct(f"records array<{REVIEW}>"))["records"]).alias("r")).select("calibrationSetId", "r.*")
    return headers, rows, reviews
