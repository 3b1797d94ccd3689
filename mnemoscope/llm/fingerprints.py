"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: each symbol is labelled by the lowest bit in which
it differs from its left neighbour and that bit's value; four rounds leave six labels, and a phrase begins
where a label is larger than both neighbours.  Cuts depend on a few symbols around them only, so equal
substrings are cut alike wherever they stand.  A phrase is named by a hash of its symbols, names are parsed
again, until one phrase is left.  The fingerprint holds the smallest names of all levels but the first, an eighth of them
or 64 if that is more, and one hash of the whole; so a passage that two long texts share leaves names in both.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.session import scratch_folder

LOWEST, KEPT, SHARE = 2, 64, 8  # names from this level on count; so many of the smallest are kept, or one in so many
_CHUNK, _BLOCK = 150_000, 1_000_000  # code points parsed together, and compared together
_U = np.uint64
_DE_BRUIJN = _U(0x03F79D71B4CB0A89)
_PLACE = np.zeros(64, np.uint8)
for _bit in range(64):
    _PLACE[((0x03F79D71B4CB0A89 << _bit) & (2**64 - 1)) >> 58] = _bit


def _mixed(x):
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _table():
    """Labels of the later rounds by (left neighbour, symbol); labels of a round are below 128."""
    left, x = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differ = left ^ x
    place = np.zeros_like(differ)
    for bit in range(6, -1, -1):
        place[(differ >> bit) & 1 == 1] = bit
    return (2 * place + ((x >> place) & 1)).astype(np.uint8).ravel()


_LATER = _table()


def _toss_again(labels, first):
    """The same for labels: looked up."""
    pairs = np.empty(len(labels), np.uint16)
    pairs[1:] = labels[:-1]
    pairs[1:] <<= 7
    pairs[0] = 0
    pairs |= labels
    out = _LATER.take(pairs)
    out[first] = labels[first] & 1
    return out


def _toss(x, first):
    """New labels: twice the place of the lowest bit that differs from the left neighbour, plus that bit."""
    differ = np.empty_like(x)
    differ[1:] = x[1:] ^ x[:-1]
    differ[first] = 1  # the first symbol of a text counts as different in its lowest bit
    lowest = differ & (~differ + _U(1))
    place = _PLACE.take((lowest * _DE_BRUIJN) >> _U(58))
    return place * np.uint8(2) + ((x & lowest) != 0).view(np.uint8)


def _parse(names, first):
    """One level: names of phrases and where texts begin among them.  first: where texts begin."""
    # Runs of one symbol are one symbol, so that neighbours differ.
    fresh = np.ones(len(names), bool)
    fresh[1:] = names[1:] != names[:-1]
    fresh[first] = True
    at = np.flatnonzero(fresh)
    runs = np.diff(at, append=len(names)).astype(np.uint64)
    symbols = names[at]
    long = runs > 1
    if long.any():
        symbols = symbols.copy()
        symbols[long] = _mixed(symbols[long] + runs[long] * _U(0x9E3779B97F4A7C15))
    first = np.searchsorted(at, first)
    labels = _toss(symbols, first)
    for _ in range(3):
        labels = _toss_again(labels, first)
    labels = labels.view(np.int8)
    after = np.empty_like(labels)
    after[:-1] = labels[1:]
    after[np.append(first[1:], len(symbols)) - 1] = 127  # nothing begins at a text's last symbol
    cut = labels > after
    cut[1:] &= labels[1:] > labels[:-1]
    cut[first] = True
    starts = np.flatnonzero(cut)
    within = np.arange(len(symbols)) - np.repeat(starts, np.diff(starts, append=len(symbols)))
    terms = _mixed(symbols + (within.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93))
    return _mixed(np.add.reduceat(terms, starts)), np.searchsorted(starts, first)


def fingerprint_many(texts):
    """Fingerprints of several texts, in hex digits: 16 of the whole, 8 of the bar up to which names are kept, 8 for each."""
    out = [None] * len(texts)
    waiting, size = [], 0
    for i, text in enumerate(texts):
        if text:
            waiting.append(i)
            size += len(text)
        if waiting and (size >= _CHUNK or i == len(texts) - 1):
            for j, found in zip(waiting, _fingerprints([texts[j] for j in waiting])):
                out[j] = found
            waiting, size = [], 0
    return ["0" * 16 if found is None else found for found in out]


def _fingerprints(texts):
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum([0, *map(len, texts[:-1])])
    names, level, found, roots = codes, 0, [], None
    owners, before = np.arange(len(texts)), None
    while len(owners):
        names, first = _parse(names, first)
        level += 1
        sizes = np.diff(first, append=len(names))
        if level < LOWEST:
            continue
        owner = np.repeat(owners, sizes)
        if roots is None:
            placed = _mixed(names + (np.arange(len(names)) - np.repeat(first, sizes) + 1).astype(np.uint64) * _U(0xA0761D6478BD642F))
            roots = _mixed(np.add.reduceat(placed, first) + np.array([len(t) for t in texts], np.uint64))
        found.append(owner.astype(np.uint64) << _U(32) | names >> _U(32))
        # Texts of one phrase are done; the others are parsed again.
        going = sizes > 1
        names = names[np.repeat(going, sizes)]
        owners, sizes = owners[going], sizes[going]
        first = np.cumsum(sizes) - sizes
    every = np.concatenate(found)
    every.sort()
    every = every[np.append(True, every[1:] != every[:-1])]
    ends = np.searchsorted(every, np.arange(1, len(texts) + 1, dtype=np.uint64) << _U(32))
    short, begin, out = every.astype(np.uint32).astype(">u4"), 0, []
    for root, end in zip(roots.tolist(), ends.tolist()):
        kept = max(KEPT, -(-(end - begin) // SHARE))
        # Names beyond the bar are not kept.
        bar = 0xFFFFFFFF if end - begin <= kept else int(short[begin + kept - 1])
        out.append(f"{root:016x}{bar:08x}" + short[begin:min(end, begin + kept)].tobytes().hex())
        begin = end
    return out


def _names(print_):
    return int(print_[16:24], 16), np.frombuffer(bytes.fromhex(print_[24:]), ">u4")


def likeness(a, b):
    """0 to 1 from two fingerprints: the share of phrase names they have in common (Dice), from the names that both
    would have kept; 1 for equal fingerprints, 0 if only one text has any name.

    Up to 64 names are exact; beyond that the estimate comes from at least 64 of each text's, so its
    standard error is at most about 0.06 for texts of like length.
    """
    if a == b:
        return 1.0
    if len(a) <= 16 or len(b) <= 16:
        return 0.0
    (bar_x, x), (bar_y, y) = _names(a), _names(b)
    bar = min(bar_x, bar_y)
    x, y = x[:x.searchsorted(bar, "right")], y[:y.searchsorted(bar, "right")]
    return 2 * len(set(x.tolist()).intersection(y.tolist())) / (len(x) + len(y)) if len(x) + len(y) else 0.0


def fingerprints(docs, text="text"):
    """Add ``fingerprint``; null and empty texts have sixteen zeros.  All rows and other columns stay."""
    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(fingerprint_many(texts.to_pylist()), pa.string())

    return docs.withColumn("fingerprint", found(F.coalesce(text, F.lit(""))))


def _edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COMPARED = ("doc_id {id}, part int, edge string, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double, text string")


def _compared(ids, texts, prints, next_texts, next_prints, part, edge, schema):
    edited = [_edited(t, n) for t, n in zip(texts, next_texts)]
    other = fingerprint_many(edited)
    return pa.RecordBatch.from_arrays([
        ids, pa.array([part] * len(texts), pa.int32()), pa.array([edge] * len(texts), pa.string()),
        pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array(prints, pa.string()), pa.array(other, pa.string()),
        pa.array(map(likeness, prints, other), pa.float64()), pa.array(map(likeness, prints, next_prints), pa.float64()),
        pa.array([None] * len(texts), pa.string())], names=schema)


def _squeezed(rows):
    """``text`` as zstd bytes in ``packed`` with their length ``n_bytes``: shuffles themselves only know a fast, weak codec."""
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, hash bigint, n_bytes bigint, packed binary"

    def batches(frames):
        codec = pa.Codec("zstd", compression_level=3)
        for frame in frames:
            texts = frame.column("bytes")
            packed = [codec.compress(t.as_buffer(), asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([
                frame.column("doc_id"), frame.column("hash"), pa.array([t.as_buffer().size for t in texts], pa.int64()),
                pa.array(packed, pa.binary())], names=["doc_id", "hash", "n_bytes", "packed"])

    return rows.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("bytes")).mapInArrow(batches, schema)


def _unsqueezed(batch):
    """The texts of a batch of such rows."""
    codec = pa.Codec("zstd")
    return [codec.decompress(p.as_buffer(), n, asbytes=True).decode("utf-8") if n else ""
            for p, n in zip(batch.column("packed"), batch.column("n_bytes").to_pylist())]


def compare_with_next(docs, parts=None):
    """For every document, against the next one by doc_id (after the last: the first): doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as many code points from the beginning of the next text.
    Null texts are empty; null ids come first; rows with one id are ordered by their text's hash.  Texts are
    shuffled once, compressed, into ranges of ids; each range leaves its first and last document, from which the
    neighbours across ranges are compared in a second, small step.  An only document is next to itself.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = _COMPARED.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in columns.split(", ")]
    rows = (_squeezed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).repartitionByRange(parts, "doc_id")
            .withColumn("part", F.spark_partition_id())
            .sortWithinPartitions("doc_id", "hash"))

    def blocks(batches):
        """Documents in order, about a million code points at a time."""
        for batch in batches:
            ids, texts, part = batch.column("doc_id"), _unsqueezed(batch), batch.column("part")
            begin = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= _BLOCK or i == len(texts) - 1:
                    yield ids.slice(begin, i + 1 - begin), texts[begin:i + 1], part[begin].as_py()
                    begin, size = i + 1, 0

    def edge(ids, part, which, text, mark):
        arrays = [ids, pa.array([part], pa.int32()), pa.array([which], pa.string()), pa.array([len(text)], pa.int64()),
                  pa.array([None], pa.string()), pa.array([mark], pa.string()), pa.array([None], pa.string()),
                  pa.array([None], pa.float64()), pa.array([None], pa.float64()), pa.array([text], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def compare(batches):
        held = None
        for ids, texts, part in blocks(batches):
            prints = fingerprint_many(texts)
            if held is None:
                yield edge(ids.slice(0, 1), part, "first", texts[0], prints[0])
            else:
                yield _compared(held[0], [held[1]], [held[2]], [texts[0]], [prints[0]], part, None, names)
            if len(texts) > 1:
                yield _compared(ids.slice(0, len(ids) - 1), texts[:-1], prints[:-1], texts[1:], prints[1:], part, None, names)
            held = (ids.slice(len(ids) - 1, 1), texts[-1], prints[-1], part)
        if held is not None:
            yield edge(held[0], held[3], "last", held[1], held[2])

    # Fingerprints are hex digits: only an entropy coder makes them smaller.
    path = scratch_folder(spark, "fingerprints")
    rows.mapInArrow(compare, columns).write.option("compression", "zstd").parquet(path)
    done = spark.read.parquet(path)
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    # Two rows per range: narrow in number, whatever the table's size.
    firsts = done.filter("edge = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    order = firsts.select("part", F.lead("part").over(W.orderBy("part")).alias("after"), F.min("part").over(W.orderBy("part")).alias("least"))
    order = order.select("part", F.coalesce("after", "least").alias("after"))
    lasts = (done.filter("edge = 'last'").join(order, "part")
             .join(firsts.withColumnRenamed("part", "after"), "after")
             .select("doc_id", "text", "fingerprint", "next_text", "next_print"))

    def across(batches):
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("text", "fingerprint", "next_text", "next_print")]
            yield _compared(batch.column("doc_id"), *lists, 0, None, names)

    return done.filter("edge IS NULL").select(*out).unionByName(lasts.mapInArrow(across, columns).select(*out))
