"""Exact token counts at every prefix of a text, by dynamic programming.

Every prefix has one tokenisation.  Its last token is the one vocabulary piece that ends there and whose
left neighbour, the last token of the prefix before it, stays apart from it when the two merge alone; so the
count at a prefix is one more than the count at the prefix before its last token.  Truncation and budget
questions are then answered from the stored counts, without encoding again.

The vocabulary is a BPE model of pieces with byte fallback: blanks count as U+2581, one is put before the
text, and pieces have it only at their beginning, so words are counted one by one and remembered.
"""

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mnemoscope.llm.bpe import Merges
from mnemoscope.llm.frames import packed, unpacked
from mnemoscope.llm.worker import Memo, for_task

BLANK = "▁"
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
WORDS, CHECKS = 400_000, 500_000  # what a worker remembers at most


class PrefixCounter:
    """Counts for one model file.

    A word is read once: at each prefix the program holds the pieces that may be under way, each with its
    place in the trie of pieces, the count before it and the token before it.  Their number is bounded by the
    longest piece.  A node of the trie maps a symbol to (number of the piece that ends there or None, node
    below or None).
    """

    def __init__(self, path, words=WORDS, checks=CHECKS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(BLANK in piece.lstrip(BLANK) for piece in scores):
            raise ValueError("pieces of this model cross words")
        order = {score: place for place, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pieces = [None, *scores]  # piece 0 stands for no piece: the beginning, or bytes
        merges = Merges({piece: order[score] for piece, score in scores.items()})
        nodes = {"": {}}
        for number, piece in enumerate(pieces[1:], start=1):
            for n in range(1, len(piece)):
                part = piece[:n]
                if part not in nodes:
                    nodes[part] = {}
                    above = nodes[part[:-1]]
                    above[part[-1]] = (above.get(part[-1], (None, None))[0], nodes[part])
            above = nodes[piece[:-1]]
            above[piece[-1]] = (number, above.get(piece[-1], (None, None))[1])
        self.root, self.size = nodes[""], len(pieces)
        self.apart = Memo(lambda pair: merges.apart(pieces[pair // self.size], pieces[pair % self.size]), checks)
        self.steps_of = Memo(self._steps, words)

    def close(self):
        self.apart.clear()
        self.steps_of.clear()

    def _steps(self, word):
        """Changes of the count from prefix to prefix of a word, one signed byte each."""
        root, size, apart, steps, before = self.root, self.size, self.apart, array("b"), 0
        live = [(root, 0, 0)]  # node, count before the piece, the last token's number times the number of pieces
        for symbol in word:
            longer, ended = [], 0
            for node, count, last in live:
                found = node.get(symbol)
                if found is None:
                    continue
                piece, below = found
                if below is not None:
                    longer.append((below, count, last))
                if piece is not None and not ended and apart[last + piece]:  # every prefix has one tokenisation
                    ended, after = piece, count + 1
            if not ended:
                # A symbol outside the vocabulary falls back to one token for each of its bytes.
                after = before + len(symbol.encode("utf-8", "surrogatepass"))
            steps.append(after - before)
            longer.append((root, after, ended * size))
            live, before = longer, after
        return steps.tobytes()

    def steps(self, text):
        """Changes of the count at each code point of a text."""
        if not text:
            return b""
        steps = b"".join(map(self.steps_of.__getitem__, _WORDS(BLANK + text.replace(" ", BLANK))))
        # The blank put before the text is no code point of it.
        first = np.frombuffer(steps[:2], np.int8).astype(np.int64).sum()
        return np.int8(first).tobytes() + steps[2:]


def prefix_counts(docs, path, text="text"):
    """Add n_tokens and ``prefix_steps``: one signed byte per code point, by which the token count of the
    prefix that ends there differs from that of the prefix before; their running sum is the exact count.

    A null or empty text has no token and no step.  All rows and other columns stay.
    """
    @F.arrow_udf("n_tokens bigint, prefix_steps binary")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(lambda: PrefixCounter(path)) as counter:
            for texts in batches:
                steps = [counter.steps(t.as_py()) for t in texts]
                totals = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
                yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(steps, pa.binary())], names=["n_tokens", "prefix_steps"])

    rows = packed(docs, _counted=counted(F.coalesce(text, F.lit(""))))
    return unpacked(rows, docs.columns, n_tokens=F.col("_counted.n_tokens"), prefix_steps=F.col("_counted.prefix_steps"))


def longest_within(steps, limit):
    """Code points of the longest prefix that has at most ``limit`` tokens, from a column of prefix steps."""
    def end(steps):
        within = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= limit)
        return int(within[-1]) + 1 if len(within) else 0

    @F.arrow_udf("bigint")
    def longest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([end(s.as_buffer()) for s in column], pa.int64())

    return longest(F.coalesce(steps, F.lit(b"")))


def count_at(steps, position):
    """Token count of the prefix with this many code points, from a column of prefix steps."""
    @F.arrow_udf("bigint")
    def at(steps: pa.Array, position: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(s.as_buffer(), np.int8)[:max(0, p.as_py())].sum(dtype=np.int64))
                         for s, p in zip(steps, position)], pa.int64())

    return at(F.coalesce(steps, F.lit(b"")), F.coalesce(position, F.lit(0)).cast("int"))
