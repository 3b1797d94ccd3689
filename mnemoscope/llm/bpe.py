"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

A tokenisation is the BPE one exactly when every two neighbouring tokens stay apart when their joined
bytes are merged alone.  So the encoder is a nondeterministic transducer over bytes whose hypotheses are
(last finished token, bytes of the token under way); a token may finish where its neighbour check holds.
Determinising it lazily gives states that hold all live hypotheses; a move tells the last token of the prefix it
completes.  Tokens that all hypotheses agree on are emitted, so output lags by one token's length at most.
States and moves are made when first met and are forgotten beyond a fixed number.
"""

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import functions as F

from mnemoscope.llm.worker import Memo, for_task

# Fixed: Unicode's White_Space, which is what \s means to the library whose output is matched.
SPACE = r"\t-\r \x85\xa0  -     　"
STATES, CHECKS, PIECES = 120_000, 150_000, 250_000  # what a worker remembers at most, unless told otherwise
IDS_AT_ONCE = 1 << 20  # token ids after which a task sends on what it has
NODE = 24  # bits of a trie node's number
_NODES = (1 << NODE) - 1


def read_ranks(path):
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Splitter:
    """All matches of a pattern in a text.

    Texts in Latin-1 take the standard library's engine with the classes written out; it is the same
    pattern over fewer characters, and faster.
    """

    def __init__(self, pattern):
        import regex

        latin = [chr(i) for i in range(256)]
        letters = "".join(re.escape(c) for c in latin if regex.match(r"\p{L}", c))
        numbers = "".join(re.escape(c) for c in latin if regex.match(r"\p{N}", c))
        space = r"\t-\r \x85\xa0"
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
        narrow = narrow.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        narrow = narrow.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        wide = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.narrow, self.wide = re.compile(narrow).findall, regex.compile(wide).findall

    def __call__(self, text):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)


class Merges:
    """What merging does at the borders of tokens.  ranks: token (bytes or text) to rank, lowest first."""

    def __init__(self, ranks):
        self.ranks, self.never = ranks, max(ranks.values()) + 1
        self.right_edges = Memo(lambda token: self._edges(token, -1), len(ranks) + 1)
        self.left_edges = Memo(lambda token: self._edges(token, 0), len(ranks) + 1)

    def _edges(self, token, end):
        """How the part at one end of a token grows while its symbols merge, lowest rank first and leftmost
        among equals: (rank of the merge, part at that end after it); None if the merges never make it."""
        parts, steps = [token[i:i + 1] for i in range(len(token))], []
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, self.never) for a, b in zip(parts, parts[1:])]
            lowest = min(ranked)
            if lowest == self.never:
                return None
            i = ranked.index(lowest)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            steps.append((lowest, parts[end]))
        steps.append((self.never, token))
        return steps

    def apart(self, left, right):
        """Whether two tokens stay apart when their joined symbols merge: their own merges are replayed side
        by side in the order of ranks, watching for one across the border that comes first.  Without a left
        token, whether the merges make the right one at all."""
        rights = self.left_edges[right]
        if left is None or rights is None:
            return rights is not None
        lefts = self.right_edges[left]
        if lefts is None:
            return False
        i = j = 0
        before, after = left[-1:], right[:1]
        while True:
            across = self.ranks.get(before + after, self.never)
            on_left, on_right = lefts[i][0], rights[j][0]
            if across < on_left and across <= on_right and across < self.never:
                return False
            if on_left <= on_right:
                if on_left == self.never:
                    return True
                before = lefts[i][1]
                i += 1
            else:
                after = rights[j][1]
                j += 1


class _State(dict):
    """A determinised state: byte to (next state, last token of the prefix that ends there)."""

    __slots__ = ("machine", "hypotheses")

    def __missing__(self, byte):
        move = self[byte] = self.machine.move(self, byte)
        return move


class Transducer:
    """From bytes to token ids, for any vocabulary that maps token bytes to ranks.

    A hypothesis is one number, the last finished token above the trie node of the bytes under way.  One
    of a state's hypotheses always has nothing under way: its token ends the tokenisation of the prefix
    read so far.
    """

    def __init__(self, ranks, states=STATES, checks=CHECKS):
        self.ranks, self.most_states, self.most_checks = ranks, states, checks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.width = {rank: len(token) for token, rank in ranks.items()}
        self.nobody = max(ranks.values()) + 1  # stands left of the first token
        self.merges = Merges(ranks)
        # A trie of tokens: (node << 8 | byte) to (child, rank of the token that ends there or None, whether
        # longer tokens go on).
        inner = {token[:n] for token in ranks for n in range(1, len(token))}
        number = {b"": 0} | {part: n for n, part in enumerate(inner, start=1)}
        self.depth = {n: len(part) for part, n in number.items()}
        self.trie = {number[part[:-1]] << 8 | part[-1]: (number.get(part, 0), ranks.get(part), part in inner)
                     for part in inner | ranks.keys()}
        self.states = {}
        self._forget()

    def clear(self):
        """Forget all states; they point at each other, so each is emptied."""
        for state in self.states.values():
            state.clear()
        self.states, self.apart = {}, {}

    def _forget(self):
        self.clear()
        self.start = self._state((self.nobody << NODE,))

    def _state(self, hypotheses):
        state = self.states.get(hypotheses)
        if state is None:
            state = self.states[hypotheses] = _State()
            state.machine, state.hypotheses = self, hypotheses
        return state

    def _follows(self, left, right):
        return self.merges.apart(self.bytes_of.get(left), self.bytes_of[right])

    def move(self, state, byte):
        live, ended = [], None
        for hypothesis in state.hypotheses:
            node = hypothesis & _NODES
            found = self.trie.get(node << 8 | byte)
            if found is None:
                continue
            child, rank, inner = found
            if inner:
                live.append(hypothesis - node + child)
            if rank is not None and ended is None:  # every prefix has one tokenisation
                pair = hypothesis >> NODE << 32 | rank
                known = self.apart.get(pair)
                if known is None:
                    known = self.apart[pair] = self._follows(hypothesis >> NODE, rank)
                if known:
                    ended = rank
        return self._state((*live, ended << NODE)), ended

    def encode(self, data):
        """Token ids of one piece.  A piece that is a token is that token."""
        if data in self.ranks:
            return (self.ranks[data],)
        if len(self.states) >= self.most_states or len(self.apart) >= self.most_checks:
            self._forget()
        state, lasts = self.start, []
        for byte in data:
            state, last = state[byte]
            lasts.append(last)
        return self._chain(lasts, 0, len(lasts))

    def _chain(self, lasts, begin, end):
        """The tokens between two ends of tokens."""
        out = []
        while end > begin:
            token = lasts[end - 1]
            out.append(token)
            end -= self.width[token]
        return tuple(reversed(out))

    def stream(self, data):
        """Token ids of one piece as soon as they are certain: when every hypothesis has them.

        Whatever has begun within the last token's length may still be under way, so a token comes at most
        the longest token's length after its end.
        """
        state, lasts, emitted = self.start, [], 0
        for byte in data:
            state, last = state[byte]
            lasts.append(last)
            # Where the tokens under way begin; they agree on what is before their last common end.
            begins = {len(lasts) - self.depth[h & _NODES] for h in state.hypotheses}
            while len(begins) > 1:
                latest = max(begins)
                begins.remove(latest)
                begins.add(latest - self.width[lasts[latest - 1]])
            common = begins.pop()
            yield from self._chain(lasts, emitted, common)
            emitted = max(emitted, common)
        yield from self._chain(lasts, emitted, len(lasts))


class Utf8Machine:
    """Decodes tokens one by one: a state is the bytes of an unfinished character (at most three).

    Bytes that can belong to no character become U+FFFD as soon as that is certain.
    """

    def __init__(self, bytes_of):
        self.bytes_of = bytes_of
        self.states = {}

    def state(self, pending=b""):
        if pending not in self.states:
            self.states[pending] = Memo(lambda token: self._step(pending, token), len(self.bytes_of) + 1)
        return self.states[pending]

    def _step(self, pending, token):
        data = pending + self.bytes_of[token]
        # The longest end that may still become a character stays pending.
        for n in range(min(3, len(data)), 0, -1):
            if self._unfinished(data[-n:]):
                return data[:-n].decode("utf-8", "replace"), self.state(data[-n:])
        return data.decode("utf-8", "replace"), self.state()

    @staticmethod
    def _unfinished(tail):
        try:
            tail.decode("utf-8")
        except UnicodeDecodeError as error:
            return error.start == 0 and error.reason == "unexpected end of data"
        return False

    def pieces(self, tokens):
        """Text of each token as far as it is certain, then what an unfinished end leaves."""
        state, empty = self.state(), self.state()
        for token in tokens:
            text, state = state[token]
            yield text
        if state is not empty:
            yield "�"


class Codec:
    """Encoding and decoding of whole texts with one vocabulary and one splitting pattern."""

    def __init__(self, path, pattern, pieces=PIECES, states=STATES, checks=CHECKS):
        ranks = read_ranks(path)
        self.transducer = transducer = Transducer(ranks, states, checks)
        self.split = Splitter(pattern)
        self.ids_of = Memo(lambda piece: transducer.encode(piece.encode("utf-8")), pieces)
        self.written = {rank: str(rank) for rank in ranks.values()}
        self.machine = Utf8Machine(transducer.bytes_of)

    def close(self):
        self.transducer.clear()
        self.ids_of.clear()
        self.machine.states.clear()

    def encode(self, text):
        return list(chain.from_iterable(map(self.ids_of.__getitem__, self.split(text))))

    def decode(self, ids):
        return "".join(self.machine.pieces(ids))


def _id_lists(codec, texts, most=IDS_AT_ONCE):
    """The token ids of texts as arrays of lists, each of about ``most`` ids."""
    flat, ends = array("i"), [0]
    for i, text in enumerate(texts, start=1):
        flat.extend(codec.encode(text.as_py()))
        ends.append(len(flat))
        if len(flat) >= most or i == len(texts):
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(
                pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            flat, ends = array("i"), [0]


def encode(docs, path, pattern, text="text", ids="token_ids"):
    """Add the token ids of every text as array<int>.  A null or empty text has none.

    ``path`` names the vocabulary file, which every executor must be able to open.  Only the texts go to
    Python; all rows and other columns stay as they are, and a column named ``ids`` is replaced.  Ids are sent
    on by about a million, so that none wait for a whole batch of texts.
    """
    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(lambda: Codec(path, pattern)) as codec:
            for texts in batches:
                yield from _id_lists(codec, texts)

    return docs.withColumn(ids, encoded(F.coalesce(text, F.lit(""))))


def decode(tokens, path, pattern, ids="token_ids", text="decoded"):
    """Add the text that token ids stand for; null ids count as none."""
    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(lambda: Codec(path, pattern)) as codec:
            for lists in batches:
                yield pa.array((codec.decode(x.as_py()) for x in lists), pa.string())

    return tokens.withColumn(text, decoded(F.coalesce(ids, F.array().cast("array<int>"))))


def roundtrip(docs, path, pattern, pieces=700_000, states=250_000, checks=400_000):
    """Encode every whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same codec as ``encode`` and ``decode``, without sending the ids through the JVM.  A null text
    counts as empty and gives no token and the hashes of the empty string.  Other columns are ignored.  ``pieces``, ``states`` and
    ``checks`` bound what a worker remembers, about 450 MB; they change only the speed.
    """
    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with for_task(lambda: Codec(path, pattern, pieces, states, checks)) as codec:
            for texts in batches:
                counts, listed, decoded = [], [], []
                for text in texts:
                    ids = codec.encode(text.as_py())
                    counts.append(len(ids))
                    listed.append(hashlib.sha256(" ".join(map(codec.written.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                                                 names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.coalesce("text", F.lit(""))).alias("d")).select("doc_id", "d.*")
