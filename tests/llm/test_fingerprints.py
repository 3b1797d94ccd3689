"""Fingerprints: equal texts, local consistency, edited texts and neighbours."""

import hashlib
import random

from mnemoscope.llm import fingerprints as fp
from tests.llm import cases


WORD = 2**64 - 1


def scrambled(x):
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & WORD
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & WORD
    return x ^ x >> 33


def phrases(names):
    """One level of the parse, symbol by symbol: the names of the phrases."""
    runs = []
    for name in names:
        if runs and runs[-1][0] == name:
            runs[-1][1] += 1
        else:
            runs.append([name, 1])
    symbols = [scrambled(n + k * 0x9E3779B97F4A7C15 & WORD) if k > 1 else n for n, k in runs]
    labels = symbols
    for _ in range(4):
        after = [labels[0] & 1]
        for left, x in zip(labels, labels[1:]):
            place = next(bit for bit in range(64) if (left ^ x) >> bit & 1)
            after.append(2 * place + (x >> place & 1))
        labels = after
    cuts = [i for i in range(len(labels)) if i == 0 or (labels[i] > labels[i - 1] and i + 1 < len(labels) and labels[i] > labels[i + 1])]
    return [scrambled(sum(scrambled(s + (j + 1) * 0xD6E8FEB86659FD93 & WORD) for j, s in enumerate(symbols[a:b])) & WORD)
            for a, b in zip(cuts, [*cuts[1:], len(symbols)])]


def walked(text):
    """A fingerprint, from the definition."""
    if not text:
        return "0" * 16
    names = phrases(phrases([ord(c) for c in text]))
    root = scrambled(sum(scrambled(n + (i + 1) * 0xA0761D6478BD642F & WORD) for i, n in enumerate(names)) + len(text) & WORD)
    short = {n >> 32 for n in names}
    while len(names) > 1:
        names = phrases(names)
        short |= {n >> 32 for n in names}
    kept = max(64, -(-len(short) // 8))
    chosen = sorted(short)[:kept]
    return f"{root:016x}{chosen[-1] if len(short) > kept else 0xFFFFFFFF:08x}" + "".join(f"{n:08x}" for n in chosen)


def test_fingerprints_equal_a_walk_from_the_definition():
    rng = random.Random(12)
    texts = ["", "a", "aa", "aab", "abab" * 30, "x" * 500, "\n", "中文 😀 a", "\x00\x00\x01"] + [cases.prose(rng, n) for n in (1, 2, 9, 70, 400, 3000)]
    texts += ["".join(rng.choice("ab ") for _ in range(n)) for n in (5, 40, 900)]
    assert fp.fingerprint_many(texts) == [walked(t) for t in texts]


def shares(a, b):
    """Dice share of all names, from fingerprints that keep everything."""
    return 2 * len(a & b) / (len(a) + len(b))


def test_likeness_estimates_the_share_of_common_names():
    rng = random.Random(13)
    shared = cases.prose(rng, 3000)
    x, y = cases.prose(rng, 3000) + " " + shared, shared + " " + cases.prose(rng, 1500)
    every = []
    for text in (x, y):
        names, found = phrases([ord(c) for c in text]), set()
        while len(names) > 1:
            names = phrases(names)
            found |= {n >> 32 for n in names}
        every.append(found)
    assert abs(fp.likeness(*fp.fingerprint_many([x, y])) - shares(*every)) < 0.06
    # A passage that two long texts share is seen however long they are.
    long = [cases.prose(rng, 40_000) + " " + shared + " " + cases.prose(rng, 100) for _ in range(2)]
    assert fp.likeness(*fp.fingerprint_many(long)) > 0.02


def test_equal_substrings_share_names_whatever_their_offset():
    rng = random.Random(1)
    shared = cases.prose(rng, 400)
    names = [set(phrases(phrases([ord(c) for c in cases.prose(rng, n) + " " + shared + " " + cases.prose(rng, n)]))) for n in (20, 61)]
    assert len(names[0] & names[1]) > 0.85 * min(map(len, names))


def test_batches_do_not_change_fingerprints():
    rng = random.Random(2)
    texts = ["", "a", "aa", "aaaaaaaa", "ab" * 50, "中文", "😀😀", "\x00"] + [cases.prose(rng, n) for n in (1, 3, 50, 900)]
    together = fp.fingerprint_many(texts)
    assert together == [fp.fingerprint_many([t])[0] for t in texts]
    assert len(set(together)) == len(texts) and together[0] == "0" * 16


def test_likeness():
    rng = random.Random(3)
    text = cases.prose(rng, 600)
    half = text[:len(text) // 2] + cases.prose(rng, 300)
    x, y, z = fp.fingerprint_many([text, half, cases.prose(random.Random(9), 600)])
    assert fp.likeness(x, x) == 1.0 and 0.3 < fp.likeness(x, y) < 0.75 and fp.likeness(x, z) < 0.25
    assert fp.likeness("0" * 16, x) == 0.0


def kept_likeness(a, b):
    if a == b:
        return 1.0
    sides = [(int(f[16:24], 16), {int(f[i:i + 8], 16) for i in range(24, len(f), 8)}) for f in (a, b) if len(f) > 16]
    if len(sides) < 2:
        return 0.0
    bar = min(bar for bar, _ in sides)
    x, y = ({n for n in names if n <= bar} for _, names in sides)
    return shares(x, y) if x or y else 0.0


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    texts = [rows[i][1] or "" for i in order]
    out = []
    for k, i in enumerate(order):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = (walked(t) for t in (text, edited, following))
        out.append((rows[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, kept_likeness(a, b), kept_likeness(a, c)))
    return sorted(out)


def test_comparison_equals_brute_force(spark):
    rng = random.Random(4)
    docs = cases.awkward(spark, [cases.prose(rng, rng.randrange(0, 40)) for _ in range(80)]).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for parts in (1, 7, 300):
        got = fp.compare_with_next(docs, parts)
        assert sorted(map(tuple, got.collect())) == want
    odd = cases.awkward(spark)
    assert fp.compare_with_next(odd, 3).count() == odd.count()
    assert fp.compare_with_next(cases.empty(spark)).count() == 0
    one = docs.filter("doc_id = 105")
    assert fp.compare_with_next(one).first().near_next == 1.0
    assert fp.fingerprints(odd).columns == [*odd.columns, "fingerprint"]


def test_texts_travel_compressed(spark):
    rng = random.Random(4)
    texts = [cases.prose(rng, 300) for _ in range(20)] + ["", "\u00e4\U0001f600\x00 end", None]
    rows = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "doc_id bigint, text string")
    packed = fp._squeezed(rows)
    got = packed.orderBy("doc_id").toArrow()
    assert [t for b in got.to_batches() for t in fp._unsqueezed(b)] == [t or "" for t in texts]
    assert sum(map(len, got.column("packed").to_pylist())) < 0.7 * sum(len((t or "").encode()) for t in texts)
