"""The prefix trie of conversations that begin with the first turns of another one, by monoid fingerprints.

A conversation is rebuilt from a head, the first turns of its base, and a suffix, its own turns after as many.  A turn
is a reference (a SHA-256 of role and text) and an element (x, B) of the monoid (x, b) . (y, c) = (x + b * y, b * c) modulo a
prime; the first component of the product of a sequence is its fingerprint.  Products of all prefixes of the original
conversations come from one running sum.  The product of a rebuilt prefix is the base's head product times the own
suffix's, which is the quotient of two own prefix products, so rebuilt texts are never made: texts are read once,
for their references and lengths, and are never shuffled.

Rebuilt prefixes with one depth and fingerprint are a node.  That they are equal is verified from the stored
references: in every group all last turns and all parents must be the same, which proves by induction that whole
prefixes are.  If a group fails, everything is done again with other bases of the fingerprint.

Sums over subtrees need no walk: every node belongs to the chain of its smallest member, and the nodes of a subtree
are the chains of its members, the top's own chain from the top on.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from mnemoscope.llm.skew import counted_join
from mnemoscope.operators.scans import range_blocks, running
from mnemoscope.session import materialized

PRIME = 2**61 - 1
SPAN, HEADS = 5, 9  # conversations that share a base, and how many lengths a head may have
_REF = ["r1", "r2", "r3", "r4"]
_KEY = ["depth", "f1", "f2"]
_ENDS = 65_536  # ids that are joined into one string


def _bases(seed):
    return [2 + int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big") % (PRIME - 3) for i in (1, 2)]


def _residue(x):
    return F.pmod(x.cast("decimal(38,0)"), F.lit(PRIME).cast("decimal(38,0)")).cast("bigint")


def _times(x, y):
    """Product modulo the prime; both factors have at most 19 digits."""
    return _residue(x.cast("decimal(19,0)") * y.cast("decimal(19,0)"))


def _terms(bases):
    """x * B^position for both fingerprints."""
    @F.arrow_udf("t1 bigint, t2 bigint")
    def terms(xs: pa.Array, ys: pa.Array, positions: pa.Array) -> pa.Array:
        found = [pa.array([x * pow(base, n, PRIME) % PRIME for x, n in zip(values.to_pylist(), positions.to_pylist())], pa.int64())
                 for base, values in zip(bases, (xs, ys))]
        return pa.StructArray.from_arrays(found, names=["t1", "t2"])

    return terms


def turn_references(turns):
    """conv_id, turn, r1 to r4 (a hash of role and text in four parts of 60 bits), n_bytes of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length says where the text begins.
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    parts = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(name) for i, name in enumerate(_REF)]
    return (turns.filter("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
            .select("conv_id", "turn", *parts, "n_bytes"))


def positions(references):
    """Turns in blocks, with their place ``pos`` in the conversation from 1; a conversation may hold any share of them."""
    order = ["turn", *_REF, "_unique"]
    blocks = range_blocks(references.withColumn("_unique", F.monotonically_increasing_id()), ["conv_id"], order)
    return running(blocks, ["conv_id"], order, rank="pos", keep_blocks=True)


def prefix_products(placed, bases):
    """h1, h2 of every turn: the product of its conversation up to it; t1, t2: its own term in them."""
    terms = _terms(bases)(F.col("r1"), F.col("r2"), F.col("pos"))
    rows = placed.withColumn("_t", terms).select("*", F.col("_t.t1").cast("decimal(19,0)").alias("t1"), F.col("_t.t2").cast("decimal(19,0)").alias("t2")).drop("_t")
    summed = running(rows, ["conv_id"], ["pos"], sums={"h1": "t1", "h2": "t2"})
    return summed.select("conv_id", "pos", *_REF, "n_bytes", _residue(F.col("h1")).alias("h1"), _residue(F.col("h2")).alias("h2"),
                         F.col("t1").cast("bigint").alias("t1"), F.col("t2").cast("bigint").alias("t2"))


def rebuilt(products, span=SPAN, heads=HEADS):
    """One row per conversation: how much of its base and of itself it keeps, and the products at both cuts."""
    turn = F.struct("pos", "h1", "h2", "t1", "t2", *_REF, "n_bytes")
    first = F.sort_array(F.collect_list(F.when(F.col("pos") < heads, turn)))  # fewer than ``heads`` of each
    convs = materialized(products.groupBy("conv_id").agg(F.max("pos").alias("n"), first.alias("own")), "trie-heads")
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("own").alias("theirs"))
    cut = F.crc32(F.col("conv_id").cast("string")) % heads
    rows = (convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).join(base, "base", "left")
            .withColumn("cut", cut).withColumn("head", F.least("cut", F.coalesce("n_base", F.lit(0))).cast("int")))

    def product(turns, n, name):
        return F.when(n > 0, F.get(turns, (n - 1).cast("int"))[name]).otherwise(F.lit(0).cast("bigint"))

    return rows.select(
        "conv_id", "n", "cut", "head", (F.col("head") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).alias("length"),
        *[F.coalesce(product(F.col("own"), F.col("cut"), name), F.lit(0)).alias(f"own_{name}") for name in ("h1", "h2")],
        *[product(F.col("theirs"), F.col("head"), name).alias(f"head_{name}") for name in ("h1", "h2")],
        F.when(F.col("head") > 0, F.slice("theirs", F.lit(1), F.col("head"))).alias("turns"))


def members(products, convs, bases, heads=HEADS):
    """One row for each rebuilt prefix: its conversation, key, parent's fingerprint, last turn, whether all ends there."""
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("f1", "f2", "p1", "p2", *_REF, "n_bytes")],
                         (F.col("length") == 0).alias("ends"))
    head = convs.select("conv_id", "length", F.explode("turns").alias("t"))
    head = head.select("conv_id", F.col("t.pos").alias("depth"), F.col("t.h1").alias("f1"), F.col("t.h2").alias("f2"),
                       *[_residue(F.col(f"t.h{i}") - F.col(f"t.t{i}")).alias(f"p{i}") for i in (1, 2)],
                       *[F.col(f"t.{c}").alias(c) for c in (*_REF, "n_bytes")], (F.col("t.pos") == F.col("length")).alias("ends"))
    # Where the base is shorter than the cut, own turns move to the front: their product is divided by powers of B.
    back = [F.array(*[F.lit(pow(base, -n, PRIME)) for n in range(heads)]) for base in bases]
    lookup = materialized(convs.filter("n > cut").drop("turns"), "trie-suffixes")
    own = counted_join(products, lookup, ["conv_id"], "n").filter("pos > cut")

    def moved(i, value):
        shift = F.get(back[i - 1], (F.col("cut") - F.col("head")).cast("int"))
        return _residue(F.col(f"head_h{i}") + _times(_residue(value - F.col(f"own_h{i}")), shift))

    own = own.select("conv_id", (F.col("pos") - F.col("cut") + F.col("head")).alias("depth"), *[moved(i, F.col(f"h{i}")).alias(f"f{i}") for i in (1, 2)],
                     *[moved(i, F.col(f"h{i}") - F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)], *_REF, "n_bytes", (F.col("pos") == F.col("n")).alias("ends"))
    return roots.unionByName(head).unionByName(own)


def _end_digests(ends):
    """depth, f1, f2, ends_sha256: hashes of the ids that end at each node, joined in order.

    A hash is sequential, so ids are joined into strings of bounded size in ranges of (node, id) first, and one pass
    streams over a node's strings: many ids of one node are few rows and never held together.
    """
    columns = "depth bigint, f1 bigint, f2 bigint, first bigint, ids string"

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, ids = frame[_KEY].to_numpy(), frame["conv_id"].to_numpy()
            fresh = np.arange(len(ids)) % _ENDS == 0
            fresh[1:] |= (keys[1:] != keys[:-1]).any(axis=1)
            begins = np.flatnonzero(fresh)
            written = list(map(str, ids))
            yield frame[_KEY].iloc[begins].assign(first=ids[begins], ids=[
                ",".join(written[a:b]) for a, b in zip(begins, [*begins[1:], len(ids)])])

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for frame in frames:
            out = []
            for depth, f1, f2, ids in zip(frame["depth"], frame["f1"], frame["f2"], frame["ids"]):
                if (depth, f1, f2) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (depth, f1, f2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*_KEY, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*_KEY, "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings = (ends.select(*_KEY, "conv_id").repartitionByRange(parts, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
               .mapInPandas(joined, columns))
    return (strings.repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "first")
            .mapInPandas(hashed, "depth bigint, f1 bigint, f2 bigint, ends_sha256 string"))


def trie(turns, span=SPAN, heads=HEADS):
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns without conv_id belong to no conversation and are left out; null roles and texts are empty; a null turn
    number comes first, and turns with one number are ordered by a hash of role and text, so equal rows are
    turns of their own.  Other columns are ignored.  An empty table has no node, not even a root.
    """
    placed = materialized(positions(turn_references(turns)), "trie-positions")
    seed = 0
    while True:
        bases = _bases(seed)
        products = materialized(prefix_products(placed, bases), "trie-products")
        convs = materialized(rebuilt(products, span, heads), "trie-convs")
        each = materialized(members(products, convs, bases, heads), "trie-members")
        nodes = materialized(each.groupBy(*_KEY, "p1", "p2", *_REF).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes")), "trie-groups")
        # Members of a group that differ in the last turn or the parent are rows of their own here.
        if nodes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").isEmpty():
            break
        seed += 1
    children = (nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = materialized(nodes.join(children, _KEY, "left").select(
        *_KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "trie-nodes")
    # What a conversation's own chain of nodes saves, and whether it ends in a leaf.
    chain = nodes.groupBy("conv_id").agg(F.sum("saved").alias("of_chain"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    chain = materialized(chain.join(convs.select("conv_id", (F.col("length") + 1).alias("rows")), "conv_id"), "trie-chains")
    below = (counted_join(each.select("conv_id", *_KEY), chain, ["conv_id"], "rows").groupBy(*_KEY)
             .agg(F.sum("of_chain").alias("of_members"), F.sum("leaf").alias("n_leaves")))
    upto = running(range_blocks(nodes.select("conv_id", *_KEY, "saved"), ["conv_id"], ["depth"]), ["conv_id"], ["depth"], sums={"upto": "saved"})
    above = upto.select(*_KEY, (F.col("upto") - F.col("saved")).alias("above"))
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = materialized(parents, "trie-parents")
    with_parent = counted_join(nodes.filter("depth > 0").select(*_KEY, "p1", "p2"), parents, ["depth", "p1", "p2"], "n_children")
    ends = materialized(_end_digests(each.filter("ends")), "trie-ends")
    return (nodes.join(below, _KEY).join(above, _KEY).join(with_parent.select(*_KEY, "parent_conv_id"), _KEY, "left").join(ends, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("of_members") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
