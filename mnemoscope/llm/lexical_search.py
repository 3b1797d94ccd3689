"""Ranked lexical search by scanning documents with an Aho-Corasick automaton of all items' terms.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case.  In UTF-8 every
byte of a character beyond ASCII is 0x80 or more, so one byte table lowers letters and turns all other characters
into blanks; patterns are terms between two blanks, so only whole terms are found, and neighbours may share a blank.

No index of the documents is made: a first scan counts the terms of each document and in how many documents each
item's term occurs, a second one counts again, scores, and keeps every task's best documents for each item.  Only
these are shuffled.  Items are worked off in blocks whose texts have a bounded size; only a block's terms are sent to tasks.
"""

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.llm.worker import for_task

BEST = 50
BLOCK_BYTES, BLOCK_ITEMS = 8_000_000, 2_000  # items' texts in a block, and how many items
_DOCS, _POOL = 256, 300_000  # documents scored together; candidates that wait for the next cut
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_only(text):
    """A text's UTF-8 bytes with A-Z lowered and every other character that no term has as a blank, between blanks."""
    return b" " + text.encode("utf-8", "surrogatepass").translate(_TABLE) + b" "


def count_terms(data):
    """Number of terms in what ``words_only`` gives: places where a term follows a blank."""
    blank = np.frombuffer(data, np.uint8) == 0x20
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


class Scanner:
    """Counts the occurrences of a list of terms in texts."""

    def __init__(self, terms):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS) if terms else None
        for number, term in enumerate(terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", number)
        if terms:
            self.automaton.make_automaton()

    def close(self):
        self.automaton = None

    def __call__(self, data):
        """Term number to its occurrences."""
        if self.automaton is None:
            return {}
        return Counter(map(itemgetter(1), self.automaton.iter(data.decode("latin-1"))))


class _Best:
    """The best documents of each item that a task has met."""

    def __init__(self, n_items, best):
        self.n_items, self.best = n_items, best
        self.bar = np.ones(n_items, np.int64)  # lower scores cannot be among the best any more
        self.items = self.scores = self.ids = np.empty(0, np.int64)
        self.no_id = np.empty(0, bool)
        self.more, self.waiting = [], 0

    def add(self, scores, ids, no_id):
        """scores: one row per document, one column per item."""
        row, item = np.nonzero(scores >= self.bar)
        self.more.append((item, scores[row, item], ids[row], no_id[row]))
        self.waiting += len(row)
        if self.waiting >= _POOL:
            self.cut()

    def cut(self):
        parts = [(self.items, self.scores, self.ids, self.no_id), *self.more]
        items, scores, ids, no_id = map(np.concatenate, zip(*parts))
        order = np.lexsort((ids, no_id, -scores, items))
        items = items[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        order, items = order[place < self.best], items[place < self.best]
        self.items, self.scores, self.ids, self.no_id = items, scores[order], ids[order], no_id[order]
        last = self.items[self.best - 1:] == self.items[:len(self.items) - self.best + 1] if len(items) >= self.best else np.empty(0, bool)
        full = np.flatnonzero(last) + self.best - 1
        self.bar[self.items[full]] = self.scores[full]
        self.more, self.waiting = [], 0


def _texts(batches):
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            yield doc_id, text.as_py()


def _statistics(texts, terms):
    """One row per term: -2 for documents with a term, -1 for terms, else the documents that hold the term."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, length = np.zeros(len(terms), np.int64), 0, 0
        with for_task(lambda: Scanner(terms)) as scan:
            for _, text in _texts(batches):
                data = words_only(text)
                n = count_terms(data)
                if n:
                    documents, length = documents + 1, length + n
                    held[list(scan(data))] += 1
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], met]), pa.int64()),
                                          pa.array(np.concatenate([[documents, length], held[met]]), pa.int64())], names=["term", "n"])

    rows = texts.mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {row.term: row.n for row in rows}
    return found.pop(-2, 0), found.pop(-1, 0), found


def _scored(texts, terms, weights, begins, members, n_items, documents, length, best):
    """item, score, doc_id of every task's best documents.  Term t is in items members[begins[t]:begins[t + 1]]."""
    def contributions(waiting):
        row = np.concatenate([np.full(len(tf), i) for i, (_, _, tf) in enumerate(waiting)])
        term = np.concatenate([np.fromiter(tf.keys(), np.int64, len(tf)) for _, _, tf in waiting])
        tf = np.concatenate([np.fromiter(tf.values(), np.int64, len(tf)) for _, _, tf in waiting])
        # Terms longer than average documents count for less; the division of 64-bit numbers rounds down.
        norm = np.array([50 + 50 * n * documents // length for _, n, _ in waiting], np.int64)[row]
        value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * norm))
        many = begins[term + 1] - begins[term]
        at = np.arange(many.sum()) + np.repeat(begins[term] - np.cumsum(many) + many, many)
        scores = np.zeros(len(waiting) * n_items, np.int64)
        np.add.at(scores, np.repeat(row, many) * n_items + members[at], np.repeat(value, many))
        return scores.reshape(len(waiting), n_items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = _Best(n_items, best), []

        def score():
            ids = np.array([0 if doc_id is None else doc_id for doc_id, _, _ in waiting], np.int64)
            found.add(contributions(waiting), ids, np.array([doc_id is None for doc_id, _, _ in waiting]))
            waiting.clear()

        with for_task(lambda: Scanner(terms)) as scan:
            for doc_id, text in _texts(batches):
                data = words_only(text)
                tf = scan(data)
                if tf:
                    waiting.append((doc_id, count_terms(data), tf))
                if len(waiting) >= _DOCS:
                    score()
            if waiting:
                score()
        found.cut()
        yield pa.RecordBatch.from_arrays([pa.array(found.items, pa.int64()), pa.array(found.scores, pa.int64()),
                                          pa.array(found.ids, pa.int64(), mask=found.no_id)], names=["item", "score", "doc_id"])

    return texts.mapInArrow(search, "item bigint, score bigint, doc_id bigint")


def _block(texts, block, best, size):
    """Ranked documents of one block of items: a list of (item_id, set of terms)."""
    terms = sorted(set().union(*(held for _, held in block)))
    number = {term: t for t, term in enumerate(terms)}
    pairs = sorted((number[term], item) for item, (_, held) in enumerate(block) for term in held)
    members = np.array([item for _, item in pairs], np.int64)
    begins = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(terms) + 1))
    documents, length, held = size(terms)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    candidates = _scored(texts, terms, weights, begins, members, len(block), documents, max(1, length), best)
    # Every task leaves at most ``best`` rows for an item; they meet by a hash of the document first, so that the
    # last sort of an item has a bounded number of rows.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    first = (candidates.withColumn("_salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("item", "_salt").orderBy(*order)))
             .filter(F.col("rank") <= best).drop("rank"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
    ids = texts.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item bigint, item_id bigint")
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs, items, best=BEST, block_bytes=BLOCK_BYTES, block_items=BLOCK_ITEMS):
    """item_id, rank, doc_id, score: the ``best`` documents of every row of ``items`` with a score above 0.

    Equal scores are ranked by ascending doc_id, null ids last; rows equal in both have ranks of their own in any
    order.  Null and empty texts have no term: such items give no row, such documents are in none and do not count.
    Every row of either table counts for itself, also repeated ones; other columns are ignored; ids are integers.
    A block's items have texts of about ``block_bytes`` together, or one item has a block of its own, so the driver and
    the automaton hold no more than that; each block scans the documents twice.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, volume = wanted.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil((volume or 0) / block_bytes))
    found = None
    for number in range(blocks):
        of_block = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number) if blocks > 1 else wanted
        block = [(row.item_id, set(words_only(row.text).split())) for row in of_block.toLocalIterator()]
        if any(held for _, held in block):
            ranked = _block(texts, block, best, lambda terms: _statistics(texts, terms))
            found = ranked if found is None else found.unionByName(ranked)
    empty = texts.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return empty if found is None else found
