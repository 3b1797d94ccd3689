"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are lexicon densities, closeness of lexicon words to the second person, capitals, punctuation and
obfuscation rates, taken from the whole text in one Arrow pass.  The lexicon is a fixed list plus word stems that
the labelled sample shows to be toxic.  Trees are fitted on the labelled rows, calibration on margins
that are cross-fitted over their folds; both are Spark ML models, so scores are computed in the JVM.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from mnemoscope.llm.frames import unpacked
from mnemoscope.llm.worker import Memo
from mnemoscope.session import materialized

# Insults and terms of contempt, in the languages of the corpus.
INSULTS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "dumb", "dumbass", "imbecile",
    "fool", "loser", "losers", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "clowns",
    "pig", "swine", "vermin", "filth", "filthy", "freak", "creep", "coward", "liar", "jerk", "bastard", "bitch",
    "asshole", "shit", "fuck", "fucking", "crap", "damn", "hate", "kill", "ugly", "useless", "disgrace", "retard",
    "dummkopf", "arschloch", "schwein", "abschaum", "dreck", "blödmann", "trottel", "wertlos", "ekelhaft",
    "imbécile", "connard", "salaud", "ordure", "débile", "crétin", "abruti", "dégoûtant", "minable",
    "imbécil", "estúpido", "basura", "escoria", "inútil", "asqueroso", "patético", "payaso", "tonto",
)
# Pronouns of the second person in the same languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu",
                 "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
# Characters that stand in for letters.
STAND_INS = str.maketrans("013457@$!€", "oieastasie")

FEATURES = ("log_words", "lexicon_rate", "lexicon_log", "distinct_lexicon", "learned_rate", "learned_log", "obfuscated_rate",
            "obfuscated_log", "second_person_rate", "near_second_person", "capital_rate", "shouted_rate", "mark_rate",
            "symbol_rate", "stand_in_rate", "lexicon_in_lines")
NEAR = 5  # words between a lexicon word and the second person
LEX, LEARNED, HIDDEN, SECOND, SHOUT, STAND = 1, 2, 4, 8, 16, 32


def _bits(word, lexicon, learned):
    """What one blank-separated word says, as bits."""
    bare = word.strip(".,;:!?\"'()[]{}<>|…“”«»#*$%&")
    low = bare.lower()
    bits = 0
    if low in lexicon:
        bits |= LEX
    elif learned and any(low[:i] in learned for i in range(3, 10)):
        bits |= LEARNED
    elif bare and not bare.isalpha():
        # Stand-ins become letters, separators between letters go: w0rthless, l.o.s.e.r
        plain = low.translate(STAND_INS)
        if plain in lexicon or "".join(c for c in plain if c.isalpha()) in lexicon:
            bits |= HIDDEN
    else:
        # Stretched letters: stuuupid
        squeezed = re.sub(r"(.)\1+", r"\1", low)
        if squeezed != low and squeezed in lexicon:
            bits |= HIDDEN
    if low in SECOND_PERSON:
        bits |= SECOND
    if len(bare) > 1 and bare.isupper():
        bits |= SHOUT
    if bare and any(c.isalpha() for c in bare) and any(not c.isalnum() and c not in "'’-" or c.isdigit() for c in bare):
        bits |= STAND
    return bits


def _features(text, bits_of):
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    bits = np.fromiter(map(bits_of.__getitem__, words), dtype=np.int64, count=n)
    lexical = np.flatnonzero(bits & (LEX | HIDDEN))
    second = np.flatnonzero(bits & SECOND)
    near = 0
    if len(lexical) and len(second):
        after = np.searchsorted(second, lexical)
        gaps = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - lexical),
                          np.abs(second[np.maximum(after - 1, 0)] - lexical))
        near = int((gaps <= NEAR).sum())
    count = {bit: int(np.count_nonzero(bits & bit)) for bit in (LEX, LEARNED, HIDDEN, SECOND, SHOUT, STAND)}
    distinct = len({words[i].lower() for i in lexical})
    chars = len(text)
    lines = text.count("\n") + 1
    return [np.log1p(n), count[LEX] / n, np.log1p(count[LEX]), float(distinct), count[LEARNED] / n, np.log1p(count[LEARNED]),
            count[HIDDEN] / n, np.log1p(count[HIDDEN]), count[SECOND] / n, float(near),
            sum(map(str.isupper, text)) / chars, count[SHOUT] / n,
            (text.count("!") + text.count("?")) / n, sum(map(text.count, "#*$%&|<>")) / chars, count[STAND] / n,
            len(lexical) / lines]


def features_of(text, learned=()):
    """The features of a text column, an array of doubles in the order of FEATURES; empty and null texts
    give zeros.  Only the text goes to Python."""
    lexicon, learned = frozenset(INSULTS), frozenset(learned)

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits_of = Memo(lambda word: _bits(word, lexicon, learned), 200_000)
        for texts in batches:
            yield pa.array([_features(t.as_py(), bits_of) for t in texts], pa.list_(pa.float64()))

    return features(F.coalesce(text, F.lit("")))


def labelled_sample(docs, labels, label="toxic", bound=20_000, folds=(0, 1, 3)):
    """At most about ``bound`` labelled documents: doc_id, text, label (0.0 or 1.0), fold.

    fold is crc32 of doc_id as text mod 4, and only the given folds are used.  Rows are chosen by another
    hash; ids with several labels count as 1 if any is.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    rows = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.max(label).cast("double").alias("label")).withColumn("fold", fold)
            .filter(F.col("fold").isin(*folds)))
    share = min(1.0, bound / max(1, rows.count()))
    # A share of the hash's whole range: as fine as 64 bits, so no table is so large that nothing is chosen.
    chosen = rows.filter(F.xxhash64(F.lit("sample"), "doc_id") / F.lit(2.0**64) + 0.5 < share)
    # Bounded by ``bound`` narrow rows.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learned_stems(sample, least=6, ratio=25.0):
    """Beginnings of words (3 to 9 letters) that the labelled sample shows to be toxic: in toxic texts they make
    up at least ``ratio`` times the share of words that they have in others, and at least ``least`` toxic texts hold
    such words.  Of a stem and its extensions only the shortest counts.  The sample bounds how many there are."""
    words = (sample.select("label", F.monotonically_increasing_id().alias("text_id"),
                           F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
             .filter(F.length("word") >= 3).groupBy("word").agg(
                 F.sum("label").alias("in_toxic"), F.sum(1 - F.col("label")).alias("in_clean"),
                 F.approx_count_distinct(F.when(F.col("label") == 1, F.col("text_id"))).alias("texts")))
    words = materialized(words, "toxicity-words")
    totals = words.agg(F.sum("in_toxic"), F.sum("in_clean")).first()
    toxic, clean = (totals[0] or 0.0), (totals[1] or 0.0)
    stems = (words.select("*", F.explode(F.sequence(F.lit(3), F.least(F.length("word"), F.lit(9)))).alias("n"))
             .groupBy(F.expr("left(word, n)").alias("stem")).agg(
                 F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"),
                 F.sum("texts").alias("texts"))
             .filter((F.col("texts") >= least) & (F.col("in_toxic") >= 2 * least)
                     & (F.col("in_toxic") * clean >= ratio * toxic * (F.col("in_clean") + 1))))
    chosen = set()
    for stem in sorted((r.stem for r in stems.select("stem").collect()), key=len):
        if not any(stem[:n] in chosen for n in range(3, len(stem))):
            chosen.add(stem)
    return sorted(chosen)


class Model:
    """A fitted scorer: learned stems, trees and the calibration of their margin."""

    def __init__(self, words, trees, calibration, base):
        self.words, self.trees, self.calibration, self.base = words, trees, calibration, base

    def transform(self, docs, keep=None):
        """Score whole texts: the ``keep`` columns (default: all) and ``score`` from 0 to 1."""
        keep = list(keep if keep is not None else docs.columns)
        rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").alias("_text"))
        scored = (self._by_trees(rows) if self.trees is not None
                  else rows.select("_row", F.lit(float(self.base)).alias("_score")))
        return unpacked(scored, keep, score=F.col("_score"))

    def _by_trees(self, rows):
        rows = rows.select("_row", array_to_vector(features_of(F.col("_text"), self.words)).alias("features"))
        rows = self.trees.transform(rows).select("_row", vector_to_array("rawPrediction")[1].alias("margin"))
        if self.calibration is None:
            return rows.select("_row", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("_score"))
        return self.calibration.transform(rows).select(
            "_row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("_score"))


def _calibration(margins):
    """Isotonic regression of labels on cross-fitted margins; equal margins are one point with their number as weight.

    One more example of either kind, at the ends of the margins, keeps shares of few positives off 0 and 1.
    """
    points = margins.groupBy("margin").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    low, high = margins.agg(F.min("margin"), F.max("margin")).first()
    ends = margins.sparkSession.createDataFrame([(low - 1.0, 0.0, 1.0), (high + 1.0, 1.0, 1.0)], "margin double, label double, weight double")
    return IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(points.unionByName(ends))


def fit(docs, labels, label="toxic", bound=20_000, held_out=2, trees=25, depth=4):
    """Fit on at most about ``bound`` labelled rows; those of fold ``held_out`` are never read.

    Only the text of a row enters its features.  The trees are fitted on all other folds; their calibration on margins
    that each of these folds gets from trees fitted on the rest, so every labelled row counts in both.  Without labels
    of both kinds the model gives every document the share of label 1, or 0 if there is no label.
    """
    folds = [f for f in range(4) if f != held_out]
    sample = materialized(labelled_sample(docs, labels, label, bound, folds), "toxicity-sample")
    words = learned_stems(sample)
    rows = materialized(sample.select("label", "fold", array_to_vector(features_of(F.col("text"), words)).alias("features")),
                        "toxicity-features").cache()
    kinds = {(r.fold, r.label): r.n for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, everything = sum(n for (_, v), n in kinds.items() if v == 1), sum(kinds.values())
    if len({v for _, v in kinds}) < 2:
        return Model(words, None, None, ones / everything if everything else 0.0)
    # A leaf of five needs more than a few rows of the rarer label.
    leaf = max(1, min(5, min(ones, everything - ones) // 10))
    booster = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2,
                            minInstancesPerNode=int(leaf), subsamplingRate=0.8, seed=7)
    margins = None
    for fold in folds:
        if len({v for f, v in kinds if f != fold}) == 2 and any(f == fold for f, _ in kinds):
            fitted = booster.fit(rows.filter(F.col("fold") != fold))
            part = fitted.transform(rows.filter(F.col("fold") == fold)).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
            margins = part if margins is None else margins.unionByName(part)
    calibration = None if margins is None else _calibration(materialized(margins, "toxicity-margins"))
    model = booster.fit(rows)
    rows.unpersist()
    return Model(words, model, calibration, ones / everything)


def score(docs, labels, threshold=0.3, **options):
    """Every document with ``score`` and ``toxic`` (1 where the score reaches the threshold).

    Null and empty texts are scored by their features, which are all zero.  All rows and columns stay.
    """
    scored = fit(docs, labels, **options).transform(docs)
    return scored.withColumn("toxic", (F.col("score") >= threshold).cast("int"))
