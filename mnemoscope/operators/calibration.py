"""The calibration gate: agreement of a scorer with labelled rows, strata, review and provenance."""

from pyspark.sql import functions as F

from mnemoscope.functions.ratio import count_where, holds, ratio
from mnemoscope.operators.archive import coverage
from mnemoscope.operators.matching import JUDGMENTS, MATCH_TYPES
from mnemoscope.sources.tables import ABILITIES

# Columns a scorer must not see.
LABEL_FIELDS = ("goldJudgment", "justification", "candidateAnswer", "edgeCases")
REQUIRED_PERCENT = 95
ROWS = (90, 110)
MIN_PER_ABILITY = 10


def without_labels(rows):
    """Rows as the scorer may see them, by naming what stays."""
    return rows.select(*[c for c in rows.columns if c not in LABEL_FIELDS])


def agreements(rows, predictions, keys):
    """Label, prediction and whether they agree; a missing or odd prediction disagrees.

    Judgments are compared, never correctness.
    """
    said = predictions.select(*keys, "judgment")
    joined = rows.select(*keys, "goldJudgment").join(said, keys, "left")
    return joined.withColumn("agrees", holds(F.col("judgment") == F.col("goldJudgment")))


def gate(agreed, keys=()):
    """Approve a scorer when matched * 100 >= total * 95, in integers."""
    counts = agreed.groupBy(*keys).agg(count_where(F.col("agrees")).alias("matched"),
                                       F.count(F.lit(1)).alias("total"))
    return (counts.withColumn("agreement", ratio("matched", "total"))
            .withColumn("approved", F.col("matched") * 100 >= F.col("total") * REQUIRED_PERCENT))


def decision(gated, provenance, require_human=True):
    """Join the gate with the provenance of its corpus: canonical use needs human labels."""
    joined = gated.join(provenance, "calibrationSetId", "left")
    human = holds(F.col("kind") == "human")
    reasons = F.filter(F.array(
        F.when(~F.col("approved"), F.concat(F.lit("agreement "), F.col("matched"), F.lit("/"), F.col("total"),
                                            F.lit(" is below required 95%"))),
        F.when(F.lit(require_human) & ~human, F.lit("human label and review provenance required"))),
        lambda r: r.isNotNull())
    return (joined.withColumn("rejectionReasons", reasons)
            .withColumn("approved", F.size("rejectionReasons") == 0)
            .withColumn("canonical", F.lit(require_human) & F.col("approved")))


def prediction_violations(predictions, keys):
    """Scorer output outside its domain: judgment, boolean correctness, match type."""
    problem = (F.when(~holds(F.col("judgment").isin(*JUDGMENTS)), "judgment")
               .when(F.col("correct").isNull(), "correct")
               .when(~holds(F.col("matchingMethod").isin(*MATCH_TYPES)), "matchingMethod"))
    return predictions.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def strata(rows, keys=("calibrationSetId",)):
    """Size and stratification of each corpus, and whether it is balanced enough to be used."""
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_where(F.col("ability") == a).alias(a) for a in ABILITIES],
        *[count_where(F.col("matchType") == m).alias(f"match_{m}") for m in MATCH_TYPES],
        count_where(~holds(F.col("ability").isin(*ABILITIES))).alias("_other"),
        count_where(~holds(F.col("matchType").isin(*MATCH_TYPES))).alias("_odd"))
    abilities = F.least(*[F.col(a) for a in ABILITIES]) >= MIN_PER_ABILITY
    kinds = F.least(*[F.col(f"match_{m}") for m in MATCH_TYPES]) > 0
    return (counts.withColumn("sizeOk", F.col("rows").between(*ROWS))
            .withColumn("abilitiesOk", abilities & (F.col("_other") == 0))
            .withColumn("matchTypesOk", kinds & (F.col("_odd") == 0))
            .withColumn("semanticOk", F.col("match_semantic") * 10 >= F.col("rows") * 3)
            .drop("_other", "_odd"))


def review_problems(rows, reviews, keys=("calibrationSetId", "probeId")):
    """Labels without a review, reviews without a label, and reviews that do not confirm theirs."""
    keys = list(keys)
    uncovered = coverage(rows, reviews, keys)
    joined = rows.select(*keys, "goldJudgment").join(reviews, keys)
    problem = (F.when(~holds(F.col("justificationConsistent")) | ~holds(F.col("evidenceConsistent")),
                      "the review leaves the label unconfirmed")
               .when(~holds(F.col("confirmedGoldJudgment") == F.col("goldJudgment")),
                     "the review confirms another judgment"))
    return uncovered.unionByName(
        joined.withColumn("problem", problem).filter("problem IS NOT NULL").select(*keys, "problem"))


def declared_counts(rows, declared, key="calibrationSetId"):
    """Reconcile declared counts with the rows: (dimension, label) whose counts differ.

    declared: calibrationSetId, dimension, label, declared.
    """
    dimension = F.explode(F.concat(
        F.array(F.struct(F.lit("abilities").alias("d"), F.col("ability").alias("l")),
                F.struct(F.lit("matchTypes").alias("d"), F.col("matchType").alias("l")),
                F.struct(F.lit("goldJudgments").alias("d"), F.col("goldJudgment").alias("l"))),
        F.transform("edgeCases", lambda tag: F.struct(F.lit("edgeCases").alias("d"), tag.alias("l")))))
    actual = (rows.select(key, dimension.alias("x"))
              .groupBy(key, F.col("x.d").alias("dimension"), F.col("x.l").alias("label"))
              .agg(F.count(F.lit(1)).alias("actual")))
    joined = actual.join(declared, [key, "dimension", "label"], "full")
    return joined.filter(~F.col("actual").eqNullSafe(F.col("declared")))


def provenance(corpora, frozen_set_ids=(), frozen_rows_hashes=()):
    """human, agent or unknown.  Names and metadata cannot turn agent-written labels into human ones.

    corpora: calibrationSetId, rowsHash, labelingMethod, reviewMethod, labelKind, labelerId,
    reviewKind, reviewerId.
    """
    def named(column):
        return holds(F.trim(column) != "")
    human = (holds(F.col("labelKind") == "human") & named("labelerId")
             & holds(F.col("reviewKind") == "human") & named("reviewerId"))
    says_agent = (F.contains(F.lower("labelingMethod"), F.lit("agent"))
                  | F.contains(F.lower("reviewMethod"), F.lit("agent")))
    agent = (F.col("calibrationSetId").isin(*frozen_set_ids) | F.col("rowsHash").isin(*frozen_rows_hashes)
             if frozen_set_ids or frozen_rows_hashes else F.lit(False)) | says_agent
    kind = (F.when(holds(agent), "agent").when(human, "human")
            .when(holds(F.col("labelKind") == "agent"), "agent").otherwise("unknown"))
    return corpora.withColumn("kind", kind)


def separation(calibration, canonical):
    """Calibration questions that also occur among the canonical questions; must be empty.

    Both sides: a normalised ``question``.  Compared by hash, so long texts do not travel.
    """
    seen = canonical.select(F.sha2("question", 256).alias("_q")).distinct()
    return (calibration.withColumn("_q", F.sha2("question", 256)).join(seen, "_q", "left_semi").drop("_q"))
