"""Near-duplicate documents with ProbMinHash.

A text is the weighted set of its five-word shingles; repeated shingles weigh 1 + ln(count).  Every shingle
is a Poisson process whose rate is its weight: its arrivals fall on random components of the signature, and
each component keeps the shingle that arrived first.  Two texts agree in a component with their probability
Jaccard similarity.  A shingle stops arriving once it is later than all components' first arrivals.  A text that
repeats shingles has a second signature with unit weights, so that pairs are proposed by the measure that verifies.

Bands of components propose pairs, exact Jaccard similarity of the shingle sets verifies them, and connected
components of the verified links are the classes.  Equal texts are one node from the start.  In a bucket only
links to one leader are tried, never all pairs: the text that shares most buckets with others.  Buckets that
still hold several classes get a leader from another one, until a round brings no new link.  No round makes more
pairs than buckets have members.  What bands and leaders miss an exact join finds: of all texts, in whatever buckets,
the untried pairs of different classes whose rarest shingles let them be similar are verified, so no link is lost.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from mnemoscope.llm.frames import packed
from mnemoscope.llm.skew import counted_join
from mnemoscope.llm.worker import Memo
from mnemoscope.session import materialized, scratch_folder

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 shares no band with probability 5e-5
SAMPLED, COMMON = 20_000, 200_000  # texts that tell which shingles are common, and so many of these; they set an order only
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_BATCH = 300_000  # shingles of the texts that are sketched together


def _mixed(x):
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of a text, sorted, and how often each occurs."""

    def __init__(self, words=SHINGLE):
        self.words = words
        self.hash_of = Memo(xxhash.xxh64_intdigest, 200_000)

    def __call__(self, text):
        # bytes.split() parts at blanks 0x20 and 0x09 to 0x0D and at nothing else
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        hashes = np.fromiter(map(self.hash_of.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.words + 1)
        width = min(self.words, len(words))
        shingles = np.zeros(n, np.uint64)
        for i in range(width):
            shingles = _mixed(shingles * _MIX[2] + hashes[i:i + n] + np.uint64(i + 1))
        return np.unique(shingles, return_counts=True)


def signatures(sets, size):
    """ProbMinHash signatures of several weighted sets at once: an array of one row per set.

    sets: list of (distinct 64-bit elements, counts), none empty.
    """
    owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    elements = np.concatenate([e for e, _ in sets])
    rates = 1 + np.log(np.concatenate([c for _, c in sets]))
    first = np.full(len(sets) * size, np.inf)
    winner = np.zeros(len(sets) * size, np.uint64)
    clock = np.zeros(len(elements))
    arrival = 0
    while len(elements):
        arrival += 1
        draw = _mixed(elements + np.uint64(arrival * int(_MIX[2]) % 2**64))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rates
        at = owner * size + (_mixed(draw ^ _MIX[0]) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, at, clock)
        won = first[at] == clock
        winner[at[won]] = elements[won]
        # Later arrivals of an element that is past every component of its set cannot win.
        going = clock < first.reshape(len(sets), size).max(axis=1)[owner]
        if not going.all():
            owner, elements, rates, clock = owner[going], elements[going], rates[going], clock[going]
    return winner.reshape(len(sets), size)


def band_hashes(signature, bands=BANDS, rows=ROWS):
    """One 64-bit bucket for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    bucket = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for i in range(rows):
        bucket = _mixed(bucket * _MIX[2] + parts[:, :, i])
    return bucket.view(np.int64)


def _node(text):
    """128 bits of a whole text: equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _common(texts, words=SHINGLE):
    """The commonest shingles of a sample of texts, sorted, and in how many of its texts each is."""
    bar = int(min(1, SAMPLED / max(1, texts.count())) * 2**20)
    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(2**20)) < bar).groupBy("node").agg(F.first("text").alias("text"))

    def shingled(frames):
        shingler = Shingler(words)
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"shingle": np.concatenate([shingler(t or "")[0] for t in frame["text"]]).view(np.int64)})

    often = (sample.mapInPandas(shingled, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"))
             .filter("texts > 1").orderBy(F.desc("texts"), "shingle").limit(COMMON).toPandas())
    shingle, count = often["shingle"].to_numpy(np.int64).view(np.uint64), often["texts"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], count[order]


def _first(shingles, similarity, common):
    """So many of a text's sorted shingles, rare ones first, that similar texts share one of them.

    All texts are in one order, by count in the sample and then by shingle; whatever that order is, the first
    shingles of two similar texts meet.  A better one only leaves fewer pairs.
    """
    places = len(shingles) - int(np.ceil(len(shingles) * similarity - 1e-9)) + 1
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        often = np.where(common[0][at] == shingles, common[1][at], 0)
        shingles = shingles[np.argsort(often, kind="stable")]
    return shingles[:places].view(np.int64)


def sketches(nodes, words=SHINGLE, bands=BANDS, rows=ROWS, similarity=SIMILARITY, common=None):
    """node, n_shingles, buckets, rare (its first shingles, see ``_first``) of every text with a word; a text that a task
    meets again is skipped."""
    common = common or (np.empty(0, np.uint64), np.empty(0, np.int64))

    def batches(frames):
        shingler, seen, waiting, total = Shingler(words), set(), [], 0

        def flush():
            sets = [s for _, s in waiting]
            found = list(band_hashes(signatures(sets, bands * rows), bands, rows))
            # Verification counts a shingle once; with unit weights the same draws give a set's signature.
            repeating = [i for i, (_, counts) in enumerate(sets) if counts.max() > 1]
            if repeating:
                plain = [(sets[i][0], np.ones(len(sets[i][0]), np.int64)) for i in repeating]
                for i, more in zip(repeating, band_hashes(signatures(plain, bands * rows), bands, rows)):
                    found[i] = np.union1d(found[i], more)
            return pd.DataFrame({"node": [n for n, _ in waiting], "n_shingles": [len(s[0]) for _, s in waiting],
                                 "buckets": found, "rare": [_first(s[0], similarity, common) for s in sets]})

        for frame in frames:
            for node, text in zip(frame["node"], frame["text"]):
                if node in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(node)
                found = shingler(text or "")
                if len(found[0]):
                    waiting.append((node, found))
                    total += len(found[0])
                if total >= _BATCH:
                    yield flush()
                    waiting, total = [], 0
        if waiting:
            yield flush()

    return nodes.mapInPandas(batches, "node binary, n_shingles bigint, buckets array<bigint>, rare array<bigint>")


def _verified(pairs, texts, words, similarity):
    """Pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    # The narrow pairs meet the texts of their leaders first; adaptive execution splits leaders with very many.
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))

    def batches(frames):
        shingler = Shingler(words)
        sets = Memo(lambda text: shingler(text)[0], 32)
        for frame in frames:
            close = []
            for text_a, text_b in zip(frame["text_a"], frame["text_b"]):
                a, b = sets[text_a], sets[text_b]
                common = len(np.intersect1d(a, b, assume_unique=True))
                close.append(common >= similarity * (len(a) + len(b) - common))
            yield frame.loc[close, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(batches, "a binary, b binary")


def components(links):
    """node, label for the nodes of links (a, b): equal labels, the smallest node, where links connect.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of
    the longest chain of links.  Each round is written, so a lost executor costs no earlier round.
    """
    both = materialized(links.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct(), "component-links")
    labels = materialized(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")), "component-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near")))
        spread = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = materialized(spread.join(jump, "via").select(
            "node", F.least("via", "far").alias("label"), (F.least("via", "far") != F.col("before")).alias("moved")), "component-labels")
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels


def _rarest(texts, words, similarity):
    """node, rare: so many of a text's shingles that similar texts must share one of them, and places: where each of them
    stands in the order of all the text's shingles."""
    found = sketches(texts, words, similarity=similarity, common=_common(texts, words))
    return found.select("node", "rare", F.sequence(F.lit(0), F.size("rare") - 1).alias("places"))


def _remaining(nodes, rare, labels, similarity):
    """All pairs (a, b) of texts of different classes that share one of their rarest shingles and may be similar."""
    return _pairs_apart(nodes.select("node", "n").join(rare, "node").select("node", "n", F.posexplode("rare").alias("place", "shingle")), labels, similarity)


def _meeting(at, similarity):
    """Pairs (a, b), with repeats, that meet in a shared shingle which stands early enough in both; at: one row for each of a
    text's shingles, with its largest class (main) and the hash of all texts that hold it (nodes)."""
    # Unequal sets of texts with one hash only make more pairs, as the places are the least ones.
    met = materialized(at.groupBy("nodes", "main", "node").agg(
        F.first("n").alias("n"), F.first("label").alias("label"), F.min("place").alias("place")), "near-met")
    one = met.filter("label != main").select("nodes", "main", F.col("node").alias("one"), F.col("n").alias("n_1"), F.col("label").alias("x"), F.col("place").alias("at_1"))
    two = met.select("nodes", "main", F.col("node").alias("two"), F.col("n").alias("n_2"), F.col("label").alias("y"), F.col("place").alias("at_2"))
    wanted = F.ceil((F.col("n_1") + F.col("n_2")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
    return (one.join(two.hint("merge"), ["nodes", "main"]).filter("x != y").filter("y = main OR one < two")
            .filter(F.least("n_1", "n_2") >= similarity * F.greatest("n_1", "n_2"))
            .filter((F.col("at_1") + wanted <= F.col("n_1")) & (F.col("at_2") + wanted <= F.col("n_2")))
            .select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")))


def _pairs_apart(each, labels, similarity):
    """The same from one row for each of a text's rarest shingles: node, n, place (from 0, in the order of all its shingles), shingle.

    All texts stand in one order of shingles.  Texts that share enough of their shingles have that many left from the
    first shared one on, in both; so pairs meet only where a shared shingle stands early enough in both.  Shingles that the
    same texts hold make the same pairs and count as one, at the first one's place.  One of a pair is outside the
    shingle's largest class, so a class of copies never meets itself.

    Then the shared ones are counted.  Of two texts the one whose first shingles end earlier has all its shared ones up to
    there among the first shingles of both; beyond it has ceil(similarity * n) - 1.  So texts with too few in common cannot be similar.
    """
    several = materialized(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("shingle"), "near-often")
    at = (each.join(several, "shingle").join(labels, "node", "left")
          .select("shingle", "node", "n", "place", F.coalesce("label", "node").alias("label")))
    at = materialized(at, "near-rest")
    # Where all texts with a shingle are of one class there is nothing to try.
    main = (at.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("texts"), F.bit_xor(F.xxhash64("node")).alias("nodes")).groupBy("shingle")
            .agg(F.max(F.struct("texts", "label")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.bit_xor("nodes").alias("nodes")).filter("kinds > 1"))
    at = materialized(at.join(main.select("shingle", F.col("main.label").alias("main"), "nodes"), "shingle"), "near-rest")
    pairs = _meeting(at, similarity).distinct()
    held = at.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("shingle").alias("shingles"))
    both = (pairs.join(held.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b")), "b"))
    beyond = F.ceil(F.greatest("n_a", "n_b") * F.lit(similarity) - F.lit(1e-9)) - 1
    least = (F.col("n_a") + F.col("n_b")) * F.lit(similarity / (1 + similarity)) - beyond
    return both.filter(F.size(F.array_intersect("of_a", "of_b")) >= least - F.lit(1e-6)).select("a", "b")


class _Tried:
    """Pairs (a, b) that have been verified, in one table that grows."""

    SCHEMA = "a binary, b binary"

    def __init__(self, spark):
        self.spark, self.folder, self.rounds = spark, scratch_folder(spark, "near-tried"), 0

    def new(self, pairs):
        """Those of ``pairs`` that have not been tried."""
        if not self.rounds:
            return pairs
        return pairs.join(self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/*"), ["a", "b"], "left_anti")

    def add(self, pairs):
        """Write the pairs of a round and read them back."""
        path = f"{self.folder}/round-{self.rounds}"
        pairs.write.parquet(path)
        self.rounds += 1
        return self.spark.read.schema(self.SCHEMA).parquet(path)


def classes(docs, words=SHINGLE, similarity=SIMILARITY, bands=BANDS, rows=ROWS):
    """doc_id, node, class_id, n_docs and keeper for every row of ``docs``.

    A class holds the documents that links of at least ``similarity`` connect; class_id is its smallest
    doc_id and n_docs its number of rows.  keeper is true for the row with the smallest (doc_id, text hash),
    null ids last; rows equal in both are keepers together.  Equal texts are always in one class, also empty
    and null ones; a text without a word has no other link, one with fewer than five words is one shingle.
    """
    rows_of = docs.select("doc_id", _node(F.col("text")).alias("node"))
    texts = docs.select(_node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = materialized(sketches(texts, words, bands, rows, similarity, _common(texts, words)), "near-sketches")
    buckets = (sketched.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
               .select("node", "n", F.explode("buckets").alias("bucket")))
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialized(buckets.join(counts, "bucket"), "near-shared")
    # A text that shares most buckets is the likeliest to be what the others are copies of: it leads.
    crowd = shared.groupBy("node").agg(F.sum(F.col("members") - 1).alias("crowd"))
    ranked = shared.join(crowd, "node").select("bucket", F.struct("crowd", "node", "n").alias("m"))
    leaders = ranked.groupBy("bucket").agg(F.max("m").alias("leader"))
    crowded = materialized(ranked.join(leaders, "bucket"), "near-buckets")
    wanted = crowd.select("node")
    # Copies go before the shuffle: one text may be a third of all rows.
    every = texts
    single = texts.groupBy("node").agg(F.first("text").alias("text"))
    texts = materialized(single.join(wanted, "node", "left_semi"), "near-texts")
    possible = F.least("m.n", "leader.n") >= similarity * F.greatest("m.n", "leader.n")
    tried, labels = _Tried(docs.sparkSession), None
    while True:
        pairs = crowded.filter("m.node != leader.node").filter(possible).select(
            F.least("m.node", "leader.node").alias("a"), F.greatest("m.node", "leader.node").alias("b")).distinct()
        links = materialized(_verified(tried.add(tried.new(pairs)), texts, words, similarity), "near-links")
        if labels is not None and links.isEmpty():
            break
        labels = _relabelled(labels, links)
        # Buckets that hold another class than their leader's get a leader from it, for all members of
        # other classes than its own.
        of_member = labels.select(F.col("node").alias("_m"), F.col("label").alias("label"))
        of_leader = labels.select(F.col("node").alias("_l"), F.col("label").alias("led"))
        member = (crowded.join(of_member, F.col("m.node") == F.col("_m"), "left").join(of_leader, F.col("leader.node") == F.col("_l"), "left")
                  .select("bucket", "m", F.coalesce("label", "m.node").alias("label"), F.coalesce("led", "leader.node").alias("led")))
        chief = (member.filter("label != led").groupBy("bucket")
                 .agg(F.max(F.struct("m", "label")).alias("chief")))
        crowded = materialized(member.join(chief, "bucket").filter("label != chief.label OR m = chief.m")
                               .select("bucket", "m", F.col("chief.m").alias("leader")), "near-buckets")
    # Classes only grow, so pairs of what are different classes now are all that can still join any.
    each = sketched.dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), F.posexplode("rare").alias("place", "shingle"))
    rest = tried.add(tried.new(_pairs_apart(each, labels, similarity)))
    # Ends that share no bucket with any text were not kept so far.
    ends = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    alone = materialized(ends.join(texts.select("node"), "node", "left_anti"), "near-alone")
    more = every.join(alone, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = texts.unionByName(materialized(more, "near-texts"))
    links = materialized(_verified(rest, texts, words, similarity), "near-links")
    if not links.isEmpty():
        labels = _relabelled(labels, links)
    of_node = (rows_of.groupBy("node").agg(
        F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first"))
        .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    of_node = materialized(of_node, "near-nodes")
    of_class = of_node.groupBy("label").agg(F.min("smallest").alias("class_id"), F.sum("copies").alias("n_docs"),
                                            F.min("first").alias("first"), F.count(F.lit(1)).alias("n_nodes"))
    placed = materialized(counted_join(of_node.select("node", "label", "copies"), materialized(of_class, "near-classes"), ["label"], "n_nodes")
                          .select("node", "copies", "class_id", "n_docs", "first"), "near-placed")
    found = counted_join(rows_of, placed, ["node"], "copies")
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return found.select("doc_id", "node", "class_id", "n_docs", keeper.alias("keeper"))


def _relabelled(labels, links):
    """Labels of all linked nodes after further links: only classes that the links join get new ones."""
    if labels is None:
        return components(links)
    ends = (links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left")
            .join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
            .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a != b"))
    joined = components(ends).withColumnRenamed("node", "old").withColumnRenamed("label", "new")
    # A node without links so far is its own class.
    nodes = labels.join(joined, F.col("label") == F.col("old"), "full").select(
        F.coalesce("node", "old").alias("node"), F.coalesce("new", "label").alias("label"))
    return materialized(nodes, "near-labels")


def deduplicate(docs, **options):
    """One document of each class: the keeper's row with all its columns; of equal keepers one stays."""
    kept = (classes(docs, **options).filter("keeper").select(F.col("doc_id").alias("_id"), F.col("node").alias("_kept")).distinct())
    rows = packed(docs, _doc=F.col("doc_id"), _node=_node(F.col("text")))
    joined = rows.join(kept, (F.col("_node") == F.col("_kept")) & F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    return joined.dropDuplicates(["_doc", "_node"]).select("_row.*")
