"""Small tables for the tests of the corpus operators, with every awkward row."""

import os
import random

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, features string, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def has_tables():
    return os.path.isdir(FOLDER)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def rows(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]


def awkward(spark, texts=()):
    """Null id, null text, null source, empty text, blanks, a very long text, repeated rows, repeated ids."""
    rng = random.Random(3)
    long_text = "\n".join(prose(rng, 40) for _ in range(800))
    odd = [(None, "no id here at all", "en", "s0", 17, None, None, None), (100, None, None, None, None, "a", "b", 0),
           (101, "", "en", "s1", 0, "a", "b", 0), (102, " \t\n\x0b ", "en", None, 5, "a", "b", 0),
           (103, long_text, "en", "s2", len(long_text), "a", "b", 0), (104, "twice the same row", "en", "s0", 18, "a", "b", 0),
           (104, "twice the same row", "en", "s0", 18, "a", "b", 0), (104, "same id, other text", "en", "s0", 19, "a", "b", 0),
           (105, "naïve 😀 text\nmit Umlauten äöü\r\n中文字 x", "de", "s1", 30, "a", "b", 0)]
    return spark.createDataFrame(odd + rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
