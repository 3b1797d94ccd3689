"""Byte-level BPE and prefix counts against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import sentencepiece
import tiktoken

from mnemoscope.llm import bpe, token_counts
from tests.llm import cases

RANKS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
ALPHABET = "ab'sST tre llvd019²½ \x85\x1c\n\r\t .,;-_ éüßÀ中日語　 😀👍🏽ाि١​́ǅªº<>|"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_to_the_text():
    codec, other, rng = bpe.Codec(RANKS, P.PATTERN), library(), random.Random(1)
    tokens = [t.decode("utf-8", "ignore") for t in codec.machine.bytes_of.values()]
    for i in range(4000):
        pool = ALPHABET if i % 2 else tokens
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(25 if i % 2 else 6)))
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text


def test_decoding_any_ids_equals_decoding_their_bytes():
    codec, other, rng = bpe.Codec(RANKS, P.PATTERN), library(), random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(50256) for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == other.decode_bytes(ids).decode("utf-8", "replace")


def test_forgetting_changes_nothing():
    ranks = bpe.read_ranks(RANKS)
    small, large = bpe.Transducer(ranks, states=50, checks=50), bpe.Transducer(ranks)
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 20)))
        assert small.encode(data) == large.encode(data)


def test_tokens_come_after_bounded_lookahead():
    machine, rng = bpe.Transducer(bpe.read_ranks(RANKS)), random.Random(5)
    longest = max(machine.width.values())
    for _ in range(300):
        data = bytes(rng.choice(b"abcdefgh theinsr.0") for _ in range(rng.randrange(1, 40)))
        if data in machine.ranks:
            continue
        read = []

        def bytewise():
            for byte in data:
                read.append(byte)
                yield byte
        covered, tokens = 0, []
        for token in machine.stream(bytewise()):
            tokens.append(token)
            covered += machine.width[token]
            assert len(read) - covered <= longest
        assert tuple(tokens) == machine.encode(data)


def test_roundtrip_of_awkward_rows(spark):
    docs, other = cases.awkward(spark), library()
    got = bpe.roundtrip(docs, RANKS, P.PATTERN).collect()
    want = [(r.doc_id, other.encode_ordinary(r.text or ""), r.text or "") for r in docs.collect()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(map(repr, (
        (i, len(ids), digest(" ".join(map(str, ids))), digest(text)) for i, ids, text in want)))
    assert bpe.roundtrip(cases.empty(spark), RANKS, P.PATTERN).count() == 0


def test_encode_and_decode_keep_rows_and_columns(spark):
    docs = cases.awkward(spark)
    encoded = bpe.encode(docs, RANKS, P.PATTERN)
    assert encoded.columns == [*docs.columns, "token_ids"]
    back = bpe.decode(encoded, RANKS, P.PATTERN).collect()
    assert len(back) == docs.count() and all(r.decoded == (r.text or "") for r in back)


def test_ids_are_sent_on_before_a_batch_ends(spark):
    import pyarrow as pa

    codec, texts = bpe.Codec(RANKS, P.PATTERN), ["one two three " * 20, "", "four", "", "five six " * 30, "seven", ""]
    parts = [part.to_pylist() for part in bpe._id_lists(codec, pa.array(texts), 50)]
    assert len(parts) == 3 and sum(parts, []) == [codec.encode(t) for t in texts]
    assert max(sum(map(len, p[:-1])) for p in parts) < 50 and not [*bpe._id_lists(codec, pa.array([], pa.string()))]
    # A batch of Spark's is answered by several.
    docs = spark.range(3).selectExpr("id", "repeat('x9 ', 500000) AS text").coalesce(1)
    assert [tuple(r) for r in bpe.encode(docs, RANKS, P.PATTERN).selectExpr("id", "size(token_ids) > 600000", "length(text)").collect()] == [
        (i, True, 1_500_000) for i in range(3)]


def test_counts_at_every_prefix_equal_the_library():
    counter = token_counts.PrefixCounter(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    for i in range(600):
        pool = "abestinorld   ▁\n\t019.,'éß中😀\x00<s>/" if i % 2 else pieces
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(20 if i % 2 else 5)))
        counts = np.cumsum(np.frombuffer(counter.steps(text), np.int8), dtype=int).tolist()
        assert counts == [len(library.encode(text[:k + 1])) for k in range(len(text))], repr(text)


def test_prefix_counts_answer_budgets(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = cases.awkward(spark)
    counted = token_counts.prefix_counts(docs, PIECES)
    assert counted.columns == [*docs.columns, "n_tokens", "prefix_steps"]
    rows = counted.withColumn("fit", token_counts.longest_within(counted.prefix_steps, 7)).withColumn(
        "at", token_counts.count_at(counted.prefix_steps, counted.n_chars * 0 + 3)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == len(library.encode(text))
        fits = [k for k in range(min(len(text), 200) + 1) if len(library.encode(text[:k])) <= 7]
        assert r.fit == max(fits)
        if r.n_chars is not None:
            assert r.at == len(library.encode(text[:3]))
    assert token_counts.prefix_counts(cases.empty(spark), PIECES).count() == 0
