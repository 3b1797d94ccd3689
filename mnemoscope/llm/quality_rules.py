"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditions.

Statistics of whole texts are taken in one Arrow pass.  On a bounded sample of labelled documents, rules are
grown one after another: each is a conjunction of thresholds that covers many poor documents and few good
ones, grown on one part of the sample, pruned on another, and kept only if it is precise there; documents it
covers are then set aside.  The list becomes one ordered CASE expression over the statistics.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mnemoscope.llm.frames import packed, unpacked
from mnemoscope.llm.toxicity import labelled_sample
from mnemoscope.session import materialized

WINDOW = 8
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_shouted",
         "n_digits", "n_marks")
RATES = {
    "mean_word": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "shouted_share": "n_shouted / n_words",
    "digit_rate": "n_digits / word_chars",
    "mark_rate": "n_marks / n_words",
    "words": "n_words",
}


def _stats(text, number):
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at blanks 0x20 and 0x09 to 0x0D only
    n = len(words)
    blanks = sum(map(text.count, " \t\n\x0b\f\r"))
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\f\r"):
            seen.add(line)
    repeated = distinct = shouted = 0
    if n:
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        distinct = len(np.unique(ids))
        shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
        if n >= WINDOW:
            # Windows are named by doubling: two words, four, eight; each name stands for exact content.
            names, width = ids, 1
            while width < WINDOW:
                pairs = np.empty(len(names) - width, dtype=[("a", np.int64), ("b", np.int64)])
                pairs["a"], pairs["b"] = names[:-width], names[width:]
                both = pairs["a"] * (names.max() + 1) + pairs["b"] if names.max() < 2**31 else pairs
                names = np.unique(both, return_inverse=True)[1].reshape(-1)
                width *= 2
            twice = (np.bincount(names) > 1)[names]
            cover = np.zeros(n + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            repeated = int((np.cumsum(cover[:-1]) > 0).sum())
    return (n, len(text) - blanks, sum(map(text.count, SYMBOLS)), dup, repeated, len(lines), distinct, shouted,
            sum(map(text.count, "0123456789")), text.count("!") + text.count("?"))


class _Numbers(dict):
    """A number for each word that is looked up."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def statistics(text):
    """A struct of the STATS of a text column, all long; null and empty texts give zeros and one line.

    n_words: runs of other characters than blanks; word_chars: their code points; n_dup_lines: lines with a word equal to an
    earlier line; n_repeat_words: words in eight-word windows that the text has at least twice.
    """
    @F.arrow_udf(", ".join(f"{s} bigint" for s in STATS))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = _Numbers()
        for texts in batches:
            rows = []
            for text in texts:
                if len(number) > 300_000:  # between texts only: numbers must agree within one
                    number = _Numbers()
                rows.append(_stats(text.as_py(), number))
            table = np.array(rows, np.int64).reshape(-1, len(STATS))
            yield pa.StructArray.from_arrays([pa.array(column) for column in table.T], names=list(STATS))

    return counted(F.coalesce(text, F.lit("")))


def rates(frame):
    """Add the RATES of a frame with STATS columns; zero denominators give 0."""
    return frame.withColumns({name: F.coalesce(F.expr(f"try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]})" if " / " in e else e)
                                               .cast("double"), F.lit(0.0)) for name, e in RATES.items()})


def _grow(x, poor, names, most):
    """Add the condition with the best FOIL gain until no poor share is gained."""
    rule, covered = [], np.ones(len(x), bool)
    while len(rule) < most:
        p, n = poor[covered].sum(), (~poor[covered]).sum()
        if n == 0 or p == 0:
            break
        before, best = np.log2(p / (p + n)), None
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[covered, f], np.linspace(0.02, 0.98, 49))):
                for over in (True, False):
                    hit = covered & ((x[:, f] > cut) if over else (x[:, f] <= cut))
                    hp = (hit & poor).sum()
                    if hp == 0 or hit.sum() == covered.sum():
                        continue
                    gain = hp * (np.log2(hp / hit.sum()) - before)
                    if best is None or gain > best[0]:
                        best = (gain, f, over, float(cut), hit)
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1:4])
        covered = best[4]
    return rule


def _covers(rule, x):
    covered = np.ones(len(x), bool)
    for f, over, cut in rule:
        covered &= (x[:, f] > cut) if over else (x[:, f] <= cut)
    return covered


def learn(x, poor, names, precision=0.9, least=8, most_rules=12, most_conditions=3, seed=11):
    """A list of rules, each a list of (name, over, cut), for the poor documents among the rows of ``x``."""
    order = np.random.default_rng(seed).permutation(len(x))
    grow, prune = order[: len(x) * 2 // 3], order[len(x) * 2 // 3:]
    rules = []
    while len(rules) < most_rules and poor[grow].sum() >= least:
        rule = _grow(x[grow], poor[grow], names, most_conditions)
        if not rule:
            break

        def worth(r):
            hit = _covers(r, x[prune])
            p = (hit & poor[prune]).sum()
            return (p + 0.5) / (hit.sum() + 1.0), p

        # Drop last conditions while that makes the rule no less precise on rows it was not grown on.
        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        share, hits = worth(rule)
        if share < precision or hits < max(2, least // 3):
            break
        rules.append([(names[f], over, cut) for f, over, cut in rule])
        grow, prune = grow[~_covers(rule, x[grow])], prune[~_covers(rule, x[prune])]
    return rules


def fit(docs, labels, bound=20_000, held_out=2, **options):
    """Learn a decision list from labels.quality (0: poor) of at most about ``bound`` labelled documents;
    rows whose crc32 of doc_id mod 4 is ``held_out`` are not read.  Without labels the list is empty."""
    folds = [f for f in range(4) if f != held_out]
    sample = labelled_sample(docs, labels, "quality", bound, folds)
    frame = rates(sample.select("label", statistics(F.col("text")).alias("s")).select("label", "s.*"))
    # Bounded by ``bound`` rows of numbers.
    rows = materialized(frame.select("label", *RATES), "quality-sample").toPandas()
    if rows.empty:
        return []
    return learn(rows[list(RATES)].to_numpy(), rows["label"].to_numpy() == 0, list(RATES), **options)


def as_sql(rules):
    """The decision list as one SQL expression: the number of the first rule that holds, else 0."""
    if not rules:
        return "0"
    whens = (" AND ".join(f"{name} {'>' if over else '<='} {cut!r}D" for name, over, cut in rule) for rule in rules)
    return "CASE " + " ".join(f"WHEN {when} THEN {i + 1}" for i, when in enumerate(whens)) + " ELSE 0 END"


def judge(docs, rules, min_words=20, repeat_percent=30):
    """Add the STATS, base_failed, rule (the first learned rule that holds, or 0) and kept.

    base_failed: fewer than ``min_words`` words, or more than ``repeat_percent`` of them in repeated windows.
    kept: neither base_failed nor any rule.  Null and empty texts fail.  All rows and other columns stay, but for
    columns with the new names, which are replaced.
    """
    new = (*STATS, "base_failed", "rule", "kept")
    rows = rates(packed(docs, _s=statistics(F.col("text"))).select("_row", "_s.*"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed).withColumn("rule", F.expr(as_sql(rules))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return unpacked(judged, docs.columns, **{name: F.col(name) for name in new})
