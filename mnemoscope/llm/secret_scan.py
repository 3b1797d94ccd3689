"""Secret scans: patterns propose candidates, a random forest removes false positives.

Candidates are runs of token characters, and shorter values that are assigned to a secret's name.  Their features are length, character transitions, dictionary
coverage, whether they are part of a path, and the words next to them.  The forest is trained on labelled
findings and emitted as one SQL expression over an array of features, so that scanning is a projection: no
row leaves its task and nothing is joined back.  Only built-in expressions are used.
"""

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mnemoscope.llm.frames import packed, unpacked
from mnemoscope.llm.pii import matches
from mnemoscope.session import materialized

# At least sixteen token characters, '=' only as padding at their end, or a provider's key of parts between dots;
# possessive, so a long run is read once.
CANDIDATE = (r"(?<![A-Za-z0-9_+/-])(?:SG(?:[.][A-Za-z0-9_-]{10,}+){1,2}+|(?:eyJ[A-Za-z0-9_-]{10,}+|glpat-[A-Za-z0-9_-]{10,}+)(?:[.][A-Za-z0-9_-]++){1,4}+|"
             r"[A-Za-z0-9_+/-]{16,}+(?:={1,2}+(?![A-Za-z0-9_+/=-]))?)")
POSSIBLE = r"[A-Za-z0-9_+/-]{16}|SG[.]|eyJ|glpat-"
# Prefixes that providers give their keys.
PROVIDERS = (r"^(?:AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|xox[abps]-|"
             r"AIza[0-9A-Za-z_-]{35}$|SG[.]|eyJ[A-Za-z0-9_-]{10,})")
NAMED = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|passphrase|kennwort|contraseña|clave)"
ASSIGNED = NAMED + r"[a-z_\"']{0,12}[ \t]{0,3}(?:=|:|=>|is)[ \t]{0,3}[\"'`]?$"
# A secret's name and what assigns a value to it; "is" is prose unless a word with a digit follows.
_NAMES = (r"(?:token|secret|p(?:assw(?:or)?d|assphrase|wd|rivate[_-]?key)|a(?:pi[_-]?key|ccess[_-]?key|uth)|bearer|"
          r"c(?:redential|ontrase[ñÑ]a|lave)|kennwort)")  # as NAMED, one letter read before the rest
ASSIGNMENT = _NAMES + r"[a-z_\"']{0,12}[ \t]{0,3}(?:=>|=|:|is(?=[ \t]{1,3}[\"'`]?[^ \t\r\n]{0,60}[0-9]))[ \t]{0,3}[\"'`]?"
# What may be assigned: no blanks, quotes, brackets or separators of lists and URLs, no sign of a sentence's end.
SHORTEST, LONGEST = 4, 200
_IN = r"[^\s\"'`,;&<>(){}\[\]"
VALUE = r"^(?![=:>])" + _IN + r"]{" + f"{SHORTEST - 1},{LONGEST - 1}" + r"}" + _IN + r".:?]"
DIGEST = r"(?:sha-?[0-9]{0,3}|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|integrity)[^ ]{0,4}[ \t:=\"'-]{0,4}$"
# Common words and word parts of the corpus's languages, whose share tells prose from keys.
WORD_PARTS = ("tion", "ment", "ing", "the", "and", "that", "with", "have", "from", "this", "able", "ness", "ould", "ight", "ation",
              "ent", "ers", "ion", "est", "ter", "ver", "all", "her", "pre", "pro", "con", "com", "ver", "zeit", "ung", "sch",
              "keit", "heit", "lich", "ein", "gen", "ich", "der", "die", "und", "eau", "eux", "oir", "eur", "que", "les", "des",
              "aux", "elle", "ción", "ado", "ida", "los", "las", "para", "mente", "ant", "ste", "end", "ere", "ble", "igh")
BEFORE, AFTER = 40, 12  # code points of the neighbourhood

FEATURES = ("length", "upper_share", "digit_share", "class_changes", "hex", "distinct_share", "vowel_share", "dictionary",
            "longest_letters", "separators", "provider", "in_path", "named", "assigned", "digest_word", "quoted")


def _features(value, before, after):
    """The features of a candidate and its neighbourhood as an array of doubles."""
    n = F.length(value)
    low = F.lower(value)
    count = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    changes = F.regexp_count(value, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"))
    covered = n - F.length(F.regexp_replace(low, "|".join(sorted(set(WORD_PARTS), key=len, reverse=True)), ""))
    longest = F.array_max(F.transform(F.split(low, "[^a-z]+"), lambda part: F.length(part)))
    near, share = F.lower(before), lambda c: c / n
    flag = lambda c: c.cast("double")
    path = before.rlike(r"(?:://|[/\\]|www\.)[^ ]*$") | after.rlike(r"^(?:[/\\]|\.[a-z]{2,4}\b)") | value.rlike("^/|/.*/")
    return F.array(*[c.cast("double") for c in (
        n, share(count("[A-Z]")), share(count("[0-9]")), share(changes), flag(low.rlike("^[0-9a-f]+$") & value.rlike("[0-9]")),
        share(F.size(F.array_distinct(F.split(value, "")))), share(count("[aeiouAEIOU]")), share(covered), longest,
        share(count("[A-Za-z0-9]") * -1 + n), flag(value.rlike(PROVIDERS)), flag(path), flag(near.rlike(NAMED)),
        flag(near.rlike(ASSIGNED)), flag(near.rlike(DIGEST)), flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")))])


def candidates(text):
    """All candidates of a text column: array of (start, end, features), positions in code points."""
    runs = matches(text, CANDIDATE, text.rlike(POSSIBLE))
    # Values of secrets' names that no run touches; those of names inside one another's values may coincide.
    named = F.transform(matches(text, "(?i)" + ASSIGNMENT, F.lit(True)), lambda s: F.struct(s.end.alias("start"), F.regexp_extract(
        F.substring(text, s.end.cast("int") + 1, F.lit(LONGEST)), VALUE, 0).alias("value")))
    values = F.transform(F.filter(named, lambda s: s.value != ""), lambda s: F.struct(
        s.start.alias("start"), (s.start + F.char_length(s.value)).alias("end"), s.value.alias("value")))
    apart = F.filter(values, lambda s: ~F.exists(runs, lambda r: (r.start < s.end) & (s.start < r.end)))
    found = F.when(F.lower(text).rlike(ASSIGNMENT), F.array_sort(F.concat(runs, apart))).otherwise(runs)

    def one(s):
        before = F.substring(text, F.greatest(s.start - BEFORE, F.lit(0)).cast("int") + 1, F.least(s.start, F.lit(BEFORE)).cast("int"))
        after = F.substring(text, s.end.cast("int") + 1, F.lit(AFTER))
        return F.struct(s.start.alias("start"), s.end.alias("end"), _features(s.value, before, after).alias("features"))
    return F.transform(found, one)


def labelled_findings(docs, bound=20_000, texts=200_000):
    """Findings with a label where the neighbourhood settles it: features, label.

    A key with a provider's prefix, or one assigned to a secret's name, is a secret (1.0), unless it is a
    short value of letters only, which may be prose; one that follows the name of a digest, lies in a path or is mostly dictionary words under no such name is none (0.0); others are
    left out.  Taken from about ``texts`` documents, and at most about ``bound`` findings are kept.  Use this
    where no reviewed findings are at hand.
    """
    share = min(1.0, texts / max(1, docs.count()))
    # A share of the hash's whole range: as fine as 64 bits, so no table is so large that nothing is chosen.
    some = docs.filter(F.xxhash64(F.lit("secrets"), "doc_id") / F.lit(2.0**64) + 0.5 < share)
    rows = some.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c")).select("c.features")
    at = {name: F.col("features")[i] for i, name in enumerate(FEATURES)}
    prose = (at["length"] < 16) & (at["longest_letters"] == at["length"])
    label = (F.when((at["provider"] == 1) | ((at["assigned"] == 1) & (at["in_path"] == 0) & ~prose), 1.0)
             .when((at["digest_word"] == 1) | (at["in_path"] == 1), 0.0)
             # Card, telephone and order numbers: digits alone are no secret unless they are assigned to one's name.
             .when((at["digit_share"] == 1) & (at["assigned"] == 0), 0.0)
             .when((at["named"] == 0) & (at["digit_share"] < 0.05) & (at["hex"] == 0), 0.0))
    found = materialized(rows.withColumn("label", label).filter("label IS NOT NULL"), "secret-findings")
    n = found.count()
    return found.sample(bound / n, seed=5) if n > bound else found


def hide_neighbours(findings):
    """Every finding twice: as it is, and with what its neighbourhood says left out, so that the forest also
    learns what keys themselves look like."""
    first = FEATURES.index("in_path")
    bare = F.transform("features", lambda v, i: F.when(i >= first, F.lit(0.0)).otherwise(v))
    return findings.select("label", F.explode(F.array("features", bare)).alias("features"))


def fit(findings, trees=20, depth=6):
    """A forest over labelled findings (features, label), as SQL: the share of trees that vote for a secret.

    ``label`` is 1.0 for a secret.  With findings of one kind only, the share is constant; with none it falls
    back to whether the candidate is assigned to a secret's name or has a provider's prefix.
    """
    rows = findings.select("label", array_to_vector("features").alias("features")).cache()
    kinds = {r.label for r in rows.select("label").distinct().collect()}
    if len(kinds) < 2:
        fallback = f"greatest(f[{FEATURES.index('provider')}], f[{FEATURES.index('assigned')}])"
        return fallback if not kinds else f"{kinds.pop()}D"
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3, minInstancesPerNode=3).fit(rows)
    rows.unpersist()
    votes = " + ".join(f"({_tree_sql(tree.toDebugString)})" for tree in forest.trees)
    return f"({votes}) / {trees}D"


def _tree_sql(printed):
    """One tree as nested conditions, from the indented text in which Spark prints it."""
    lines = [line.strip() for line in printed.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]

    def node(i):
        if lines[i].startswith("Predict"):
            return f"{float(lines[i].split(':')[1])}D", i + 1
        feature, cut = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", lines[i]).groups()
        yes, i = node(i + 1)
        no, i = node(i + 1)
        return f"if(f[{feature}] <= {float(cut)!r}D, {yes}, {no})", i

    return node(0)[0]


def scan(docs, forest, text="text", least=0.5):
    """Add ``candidates`` and ``secrets``: arrays of (start, end, score) in code points of the whole text; secrets
    are the candidates whose score reaches ``least``.  Null and empty texts have none; all rows and other
    columns stay."""
    whole = F.coalesce(F.col(text), F.lit(""))
    scored = F.expr(f"transform(_found, c -> named_struct('start', c.start, 'end', c.end, "
                    f"'score', round(element_at(transform(array(c.features), f -> {forest}), 1), 4)))")
    rows = packed(docs, _found=candidates(whole)).select("_row", scored.alias("_scored"))
    return unpacked(rows, docs.columns, candidates=F.col("_scored"), secrets=F.filter("_scored", lambda s: s.score >= least))
