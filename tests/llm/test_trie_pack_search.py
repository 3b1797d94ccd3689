"""Prefix trie, packing and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from mnemoscope.llm import lexical_search, packing, prefix_trie, queries
from tests.llm import cases

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, h1 int"
SPECIALS = {"<|endoftext|>": 50256}


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for node, held in members.items():
        inner = [v for v in members if v[:len(node)] == node]
        ends = sorted(c for c in held if len(built[c]) == len(node))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), sum(len(v) == len(node) + 1 for v in inner),
                    sum(not any(w != v and w[:len(v)] == v for w in inner) for v in inner),
                    sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in inner if v),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def conversations(n, seed=1):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "no conversation"), (3, None, "user", "before all"), (3, 5, None, None), (4, 1, None, "x"), (4, 2, "", "x")]
    for c in range(n):
        for turn in range(rng.randrange(1, 14)):
            rows.append((c * rng.choice((1, 1, 2)), 10 + turn * 20 + c % 20, rng.choice(("user", "assistant")), rng.choice(("ä", "bb", "ccc", "", "hi"))))
    return [r for i, r in enumerate(rows) if (r[0], r[1]) not in {(x[0], x[1]) for x in rows[:i]}]


def trie_rows(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS))
    return sorted(map(tuple, got.collect()))


def test_trie_equals_brute_force(spark):
    rows = conversations(40)
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_one_long_conversation_and_of_copies(spark):
    long = [(0, i, "user", f"t{i % 3}") for i in range(700)]
    copies = [(c, i, "user", f"t{i}") for c in range(5, 40, 5) for i in range(3)]
    rows = long + copies + [(1, 0, "user", "short")]
    got = {(r[0], r[1]): r for r in trie_rows(spark, rows)}
    want = {(r[0], r[1]): r for r in brute_trie([r for r in rows if r[0] != 0 or r[1] < 30])}
    # The long tail adds nodes of one member below, which save nothing.
    assert len(got) == len(want) + 670 and all(got[k][2:4] + got[k][6:7] == want[k][2:4] + want[k][6:7] for k in want)


def test_trie_tries_other_bases_when_groups_differ(spark, monkeypatch):
    rows = [(c, i, "user", t) for c, ts in ((0, "abcdefghij"), (5, "badcefghij"), (10, "abdcefghij")) for i, t in enumerate(ts)]
    seeds, bases = [], prefix_trie._bases

    def weak(seed):
        seeds.append(seed)
        return [1, 1] if seed == 0 else bases(seed)  # with base 1 the order of turns is lost

    monkeypatch.setattr(prefix_trie, "_bases", weak)
    assert trie_rows(spark, rows) == brute_trie(rows) and seeds == [0, 1]


def test_trie_of_equal_rows_and_of_nothing(spark):
    twice = [(0, 0, "user", "a"), (0, 0, "user", "a"), (0, 1, "user", "b")]
    assert trie_rows(spark, twice) == brute_trie(twice)
    assert trie_rows(spark, []) == []


def test_end_digests_of_a_node_in_many_strings(spark):
    ends = spark.createDataFrame([(i, 0, 0, 0) for i in range(30_000)] + [(7, 1, 2, 3)], "conv_id bigint, depth bigint, f1 bigint, f2 bigint")
    got = {r.depth: r.ends_sha256 for r in prefix_trie._end_digests(ends).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest(), 1: hashlib.sha256(b"7").hexdigest()}


def packed(docs, **options):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIALS, **options)


def test_pieces_restore_every_document(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")) == SPECIALS
    rng = random.Random(5)
    texts = ["special <|endoftext|> inside", "a" * 9000, " \n\t  x　y\x85z"] + [cases.prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    docs = cases.awkward(spark, texts).repartition(5)
    want = defaultdict(int)
    for r in docs.collect():
        want[r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (1,)] += 1
    pieces = packed(docs).collect()
    got, tokens = defaultdict(int), {}
    for p in pieces:
        assert p.length == len(p.token_ids) and p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in p.token_ids))
        tokens.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.token_ids))
    for (doc_id, n), parts in tokens.items():
        # Rows with one id and one length: their pieces are told apart by what restores a wanted document.
        starts = defaultdict(list)
        for start, ids in parts:
            starts[start].append(ids)
        copies = {len(v) for v in starts.values()}
        assert len(copies) == 1
        if copies == {1} or len({tuple(map(tuple, v)) for v in starts.values() if len({tuple(x) for x in v}) > 1}) == 0:
            got[doc_id, tuple(t for start in sorted(starts) for t in starts[start][0])] += copies.pop()
    assert all(want[k] == n for k, n in got.items()) and sum(got.values()) >= docs.count() - 3
    ids = sorted(p.sequence_id for p in pieces)
    assert ids == list(range(len(pieces)))  # every piece is a sequence of its own
    assert [p.length for p in sorted(pieces, key=lambda p: p.sequence_id)] == sorted(p.length for p in pieces)
    assert packed(cases.empty(spark)).count() == 0


def test_binary_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 4096):
        lengths = packing.binary_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths) and len(lengths) == n // 2048 + bin(n % 2048).count("1")


def test_limit_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packed(cases.empty(spark), limit=1000)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, best=50):
    terms = [(doc_id, TERM.findall((text or "").translate(LOWER))) for doc_id, text in docs]
    terms = [(doc_id, t) for doc_id, t in terms if t]
    total, length = len(terms), sum(len(t) for _, t in terms)
    df = defaultdict(int)
    for _, t in terms:
        for term in set(t):
            df[term] += 1
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, t in terms:
            m = 100 - 50 + (50 * len(t) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 20 * m))
                        for w in set(TERM.findall((text or "").translate(LOWER))) if w in t)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=lambda r: r[:2])


def test_search_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [cases.prose(rng, rng.randrange(0, 30)).replace("1", " ") for _ in range(400)]
    texts += ["ÄÖ straße's x_y-z 中文 😀 Straße", "alpha" * 3, "alpha.alpha,ALPHA alpha", "\x00alpha\x7fbeta\x80gamma"]
    docs = cases.awkward(spark, texts)
    wanted = [(1, "Alpha beta 中文 gamma2 delta"), (2, None), (3, "..."), (4, "straße ÄÖ alphaalphaalpha 😀"), (5, "kappa alpha\x80 \x80gamma rho2 x"), (5, "nu mu")]
    items = spark.createDataFrame([(*w, "x", 2) for w in wanted], "item_id bigint, text string, doc_id string, score int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_search(rows, wanted)
    assert len(want) > 150
    for options in ({}, {"block_items": 2}, {"block_bytes": 20}):
        got = lexical_search.search(docs, items, **options).collect()
        assert sorted((tuple(r) for r in got if r.item_id != 5), key=lambda r: r[:2]) == [r for r in want if r[0] != 5]
        assert sorted(tuple(r) for r in got if r.item_id == 5) == sorted(r for r in want if r[0] == 5)
    assert lexical_search.search(cases.empty(spark), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_candidates_beyond_the_pool_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "_POOL", 7)
    monkeypatch.setattr(lexical_search, "_DOCS", 3)
    rng = random.Random(9)
    found, every = lexical_search._Best(4, 5), []
    for _ in range(60):
        scores = lexical_search.np.array([[rng.randrange(0, 40) for _ in range(4)] for _ in range(3)])
        ids = lexical_search.np.array([rng.randrange(1000) for _ in range(3)])
        found.add(scores, ids, ids < 0)
        every += [(item, -int(s), int(i)) for row, i in zip(scores, ids) for item, s in enumerate(row) if s > 0]
    found.cut()
    want = [r for item in range(4) for r in sorted(e for e in every if e[0] == item)[:5]]
    assert list(zip(found.items.tolist(), (-found.scores).tolist(), found.ids.tolist())) == want


def test_registered_queries(spark):
    if not cases.has_tables():
        return
    docs = spark.read.parquet(f"{cases.FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{cases.FOLDER}/benchmark.parquet").collect()
    turns = spark.read.parquet(f"{cases.FOLDER}/conversations.parquet").collect()
    got = sorted(map(tuple, queries.op13(spark, cases.FOLDER).collect()))
    assert got == brute_search([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert sorted(map(tuple, queries.op11(spark, cases.FOLDER).collect())) == brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in turns])
    pieces = queries.op12(spark, cases.FOLDER)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in pieces.filter("start = 0").collect()} == {r.doc_id for r in docs}
