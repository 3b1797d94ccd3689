"""Packing by powers of two: every document is cut into pieces of binary lengths, and pieces of one length are
the sequences of one bucket.

A document of n tokens gives n div limit pieces of ``limit`` tokens and, for what is left, one piece for each bit of
its length, longest first.  A piece is a sequence of its own, so none crosses documents and none needs padding.

Encoding runs in Arrow batches and is written once; sequences are then numbered bucket by bucket from the counts
of each task, so no piece is shuffled.
"""

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.session import materialized

LIMIT, END = 2048, 1
_FLUSH = 500_000  # tokens of the pieces that leave a task together


def special_tokens(path):
    """Special strings and their ids, from a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as lines:
        return {token["content"]: token["id"] for token in json.load(lines)["added_tokens"]}


def encoder(ranks_path, pattern, specials):
    """A function from a text to its ids; special strings inside a text are their own ids, as that file's library has it."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def binary_lengths(n, limit=LIMIT):
    """Lengths of the pieces of n tokens: as many of ``limit`` as fit, then the bits of the rest, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def _pieces(batches, encode, end, limit, task):
    """Arrow batches of pieces; ``nth`` numbers the pieces of one length within the task."""
    made = dict.fromkeys((1 << bit for bit in range(limit.bit_length())), 0)
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        rows, lengths, starts, totals, nths, crcs, flat, waiting = [], [], [], [], [], [], [], 0

        def flushed():
            offsets = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).view(np.int32)))
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array([task] * len(rows), pa.int32()),
                pa.array(nths, pa.int64()), tokens],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", "token_ids"])

        for row in range(len(ids)):
            tokens = np.append(encode(texts[row].as_py()), np.uint32(end)).astype("<u4", copy=False)
            start = 0
            for length in binary_lengths(len(tokens), limit):
                piece = tokens[start:start + length]
                rows.append(row)
                starts.append(start)
                lengths.append(length)
                totals.append(len(tokens))
                nths.append(made[length])
                crcs.append(zlib.crc32(piece))
                flat.append(piece)
                made[length] += 1
                start += length
                waiting += length
                if waiting >= _FLUSH:
                    yield flushed()
                    rows, lengths, starts, totals, nths, crcs, flat, waiting = [], [], [], [], [], [], [], 0
        if rows:
            yield flushed()


def pack(docs, ranks_path, pattern, specials=None, end=END, limit=LIMIT):
    """doc_id, start, length, token_ids, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row.

    A row's tokens are those of its whole text, then ``end``; a null or empty text has ``end`` alone, so every row
    has a piece.  Repeated rows and equal or null doc_ids are documents of their own; other columns are ignored;
    an empty table gives no piece.  ``limit`` must be a power of two.  Sequences are numbered from 0, shorter
    ones first; a number is unique over all pieces, and the offset in a sequence is always 0.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    specials = dict(specials or {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(batches, encoder(ranks_path, pattern, specials), end, limit, TaskContext.get().partitionId())

    id_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = materialized(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            cut, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint, token_ids array<int>"),
        "packing-pieces")
    # One row for each length and task; lengths are few, so the windows hold one row per task.
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    shorter = (counts.groupBy("length").agg(F.sum("n").alias("n"))
               .select("length", (F.sum("n").over(W.orderBy("length")) - F.col("n")).alias("shorter")))
    before = (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")
    first = materialized(counts.select("length", "task", before).join(shorter, "length")
                         .select("length", "task", (F.col("before") + F.col("shorter")).alias("first")), "packing-counts")
    return pieces.join(first, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), "token_ids")
