"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks of about equal size by a hash.  A source's target says how
often its blocks are drawn: some whole passes over all of them, then blocks of one more pass in permuted
order, the last of which is cut at a document.  These exact quotas of draws are split among the output
shards by a binary tree: at each node the left half receives a multivariate-hypergeometric share, so a
shard's composition is that of a uniform random deal, yet no quota is ever off by one.  Each shard then
takes its own disjoint run of every source's permuted draws, and rows are shuffled inside the shard.

Only DataFrame and SQL expressions are used.  Draws come from hashes, so reruns agree.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoscope.llm.frames import packed
from mnemoscope.operators.scans import range_blocks, running
from mnemoscope.session import materialized

WORD = r"[^ \t\n\x0B\f\r]+"
CAP = 3  # no source, and so no document, is taken more often than this
CHUNK = 512  # draws of a source that one hypergeometric choice deals with at most


def _hash(*parts):
    """A non-negative number below 2^60 from the text of its parts."""
    text = F.concat_ws("/", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _sized(docs, kept, size):
    """Rows with their size, a source key that sorts by code point with null last, and a hash."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint") if size is None else size
    return docs.select(*kept, words.alias("size"),
                       F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("source_key"),
                       F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"))


def source_targets(sizes, weights=(1, 2, 3), cap=CAP):
    """source_key, source_size, target of every source.

    Weights repeat over sources in order of their keys.  All sources together get the total size; a target
    stops at ``cap`` times its source's size and the excess goes to the others by weight, again and again:
    target = least(cap * size, weight * level) for the one level at which targets sum to the total.
    """
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ranked = running(range_blocks(sources, [], ["source_key"]), [], ["source_key"], rank="place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rated = ranked.withColumn("weight", weight).select(
        "source_key", "source_size", "weight", (F.col("source_size") * F.lit(float(cap))).alias("most"))
    rated = rated.withColumn("rate", F.col("most") / F.col("weight"))
    order = ["rate", "source_key"]
    summed = running(range_blocks(rated, [], order), [], order, sums={"most_upto": "most", "weight_upto": "weight"})
    total, all_weight = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(total or 0)) - (F.col("most_upto") - F.col("most"))) / (
        F.lit(float(all_weight or 1)) - (F.col("weight_upto") - F.col("weight")))
    # The first source, by the level at which it would stop, that need not stop.
    first = (summed.withColumn("level", level).filter("level <= rate")
             .agg(F.min_by("level", F.struct(*order)).alias("level")).first())
    target = F.least(F.col("most"), F.col("weight") * F.lit(float(first.level or 0.0)))
    return summed.select("source_key", "source_size", target.alias("target"))


def _hypergeometric(uniform, marked, population, drawn):
    """SQL for one hypergeometric number: of ``drawn`` items out of ``population``, how many are among the
    ``marked`` ones.  Inverts the distribution from its lower end with weights kept as logarithms: the
    first walk sums them, the second stops at the uniform share of that sum."""
    low = f"greatest(0, {drawn} + {marked} - {population})"
    steps = f"sequence({low}, least({marked}, {drawn}))"
    # ln of P(x) / P(x - 1), zero at the lower end
    ratio = (f"if(x = {low}, 0D, ln(cast({marked} - x + 1 as double)) + ln(cast({drawn} - x + 1 as double))"
             f" - ln(cast(x as double)) - ln(cast({population} - {marked} - {drawn} + x as double)))")
    peak = (f"aggregate({steps}, named_struct('at', 0D, 'top', 0D), (r, x) -> named_struct("
            f"'at', r.at + {ratio}, 'top', greatest(r.top, r.at + {ratio})), r -> r.top)")
    total = (f"aggregate({steps}, named_struct('at', 0D, 'sum', 0D), (r, x) -> named_struct("
             f"'at', r.at + {ratio}, 'sum', r.sum + exp(r.at + {ratio} - p)), r -> r.sum)")
    walk = (f"aggregate({steps}, named_struct('at', 0D, 'sum', 0D, 'got', cast({low} as bigint)), (r, x) -> named_struct("
            f"'at', r.at + {ratio}, 'sum', r.sum + exp(r.at + {ratio} - p), "
            f"'got', if(r.sum <= {uniform} * t, cast(x as bigint), r.got)), r -> r.got)")
    return (f"element_at(transform(array({peak}), p -> element_at(transform(array({total}), t -> {walk}), 1)), 1)")


def split_quotas(quotas, shards, seed=0):
    """Deal each source's exact number of draws to shards: source_key, shard, draws.

    ``quotas``: source_key, draws.  One row holds a node of the tree with all its sources, so the number of
    sources, plus one per 512 draws, times about 40 bytes must fit in a row; texts and documents do not
    enter.  Shards get equal numbers of draws, up to one.
    """
    root = quotas.filter("draws > 0").select(
        "source_key", F.explode(F.expr(f"transform(sequence(0, (draws - 1) div {CHUNK}), "
                                       f"c -> least({CHUNK}, draws - c * {CHUNK}))")).alias("n"))
    nodes = root.agg(F.array_sort(F.collect_list(F.struct("source_key", F.col("n").cast("bigint").alias("n")))).alias("of")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("width"), "of")
    uniform = f"((conv(substring(md5(concat_ws('/', {seed}, first, width, s.i)), 1, 13), 16, 10) + 0.5D) / 4503599627370496D)"
    got = _hypergeometric(uniform, "e.n", "s.population", "s.wanted")
    # Sources in turn: what is still in the pool, what the left side still wants, what it got.
    chain = (f"aggregate(of, named_struct('population', total, 'wanted', wanted, 'i', 0, 'got', cast(array() as array<bigint>)), "
             f"(s, e) -> element_at(transform(array({got}), g -> named_struct('population', s.population - e.n, "
             "'wanted', s.wanted - g, 'i', s.i + 1, 'got', concat(s.got, array(g)))), 1), s -> s.got)")
    width = shards
    while width > 1:
        split = (nodes.withColumn("total", F.expr("aggregate(of, 0L, (a, e) -> a + e.n)"))
                 .withColumn("half", F.expr("(width + 1) div 2"))
                 .withColumn("wanted", F.expr("if(width > 1, total * half div width, total)"))
                 .withColumn("got", F.expr(f"if(width > 1, {chain}, transform(of, e -> e.n))")))
        left = "filter(zip_with(of, got, (e, g) -> named_struct('source_key', e.source_key, 'n', g)), e -> e.n > 0)"
        right = "filter(zip_with(of, got, (e, g) -> named_struct('source_key', e.source_key, 'n', e.n - g)), e -> e.n > 0)"
        nodes = split.select(F.explode(F.expr(
            f"filter(array(named_struct('first', first, 'width', cast(half as int), 'of', {left}), "
            f"named_struct('first', cast(first + half as int), 'width', cast(width - half as int), 'of', {right})), c -> c.width > 0)")).alias("c")).select("c.*")
        width = (width + 1) // 2
    return (nodes.select(F.col("first").alias("shard"), F.explode("of").alias("e"))
            .groupBy("e.source_key", "shard").agg(F.sum("e.n").alias("draws")))


def plan_mix(docs, weights=(1, 2, 3), cap=CAP, shards=16, block_words=100_000, seed=0, keep=(), size=None):
    """One row per document: doc_id, the ``keep`` columns, source_key, size, source_size, target, and
    ``draws``, an array of (pass, shard): one entry for each time the mix takes the whole document.

    docs: doc_id, text, source; ``size`` replaces the number of words by another measure.  Null texts have
    size 0, null sources are one source, sorted last.  Rows with one doc_id and source are taken alike.
    What a source misses its target by is at most half of one document, mostly a few words.  An empty table
    gives no rows.
    """
    rows = materialized(_sized(docs, ["doc_id", *keep], size), "mix-sizes")
    sources = materialized(source_targets(rows, weights, cap), "mix-sources")
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    sources = (sources.withColumn("n_blocks", F.expr(f"greatest(1, ceil(source_size / {block_words}))").cast("bigint"))
               .withColumn("passes", whole)
               .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    # The sources' table is read from its file, so Catalyst knows its size and decides how to join it.
    place = _hash(str(seed), "doc", F.col("doc_key"))
    dealt = (rows.join(sources, "source_key").withColumn("place", place)
             .withColumn("block", F.expr("place % n_blocks")))
    blocks = (dealt.groupBy("source_key", "block")
              .agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("n_blocks", "passes", "rest")])
              .withColumn("turn", _hash(str(seed), "block", F.col("source_key"), F.col("block"))))
    order = ["turn", "block"]
    blocks = running(range_blocks(blocks, ["source_key"], order), ["source_key"], order,
                     rank="rank", sums={"upto": "words"})
    blocks = materialized(blocks.withColumn(
        "state", F.expr("case when upto <= rest then 'whole' when upto - words < rest then 'cut' else 'out' end"))
        .withColumn("room", F.expr("rest - (upto - words)")), "mix-blocks")
    # Documents of the at most one cut block of each source, by the hash, while they fit; then twice the
    # largest that still fits, and the one whose size is nearest to what is left.
    cut = blocks.filter("state = 'cut'").select("source_key", "block", "room")
    units = (dealt.join(cut, ["source_key", "block"]).groupBy("source_key", "block", "room", "place", "doc_key")
             .agg(F.sum("size").alias("words")))
    source = W.partitionBy("source_key")
    units = units.withColumn("chosen", F.sum("words").over(source.orderBy("place", "doc_key")) <= F.col("room"))
    for last in (False, False, True):
        used = F.coalesce(F.sum(F.when(F.col("chosen"), F.col("words"))).over(source), F.lit(0))
        units = units.withColumn("gap", F.col("room") - used)
        could = F.expr("NOT chosen AND words > 0 AND " + ("words < 2 * gap" if last else "words <= gap"))
        distance = F.struct(F.abs(F.col("words") - F.col("gap")), "place", "doc_key")
        units = units.withColumn("best", F.min(F.when(could, distance)).over(source)).withColumn(
            "chosen", F.col("chosen") | (could & F.coalesce(F.col("best.doc_key") == F.col("doc_key"), F.lit(False))))
    partly = units.filter("chosen").select("source_key", "doc_key", "chosen")
    # Every draw of a block: (pass, position among its source's draws).
    extra = F.when(F.col("state") == "out", F.col("passes") - 1).otherwise(F.col("passes"))
    # Passes are permuted differently: pass p starts p blocks later.  The last pass must begin with its
    # whole blocks, so it keeps the order.
    position = F.expr("pass * n_blocks + if(pass = passes, rank - 1, (rank - 1 + pass * 7) % n_blocks)")
    draws = (blocks.withColumn("last", extra).filter("last >= 0")
             .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("last"))))
             .withColumn("position", position))
    quotas = draws.groupBy("source_key").agg(F.count(F.lit(1)).alias("draws"))
    shares = split_quotas(quotas, shards, seed)
    runs = (shares.withColumn("upto", F.sum("draws").over(W.partitionBy("source_key").orderBy("shard")))
            .select("source_key", "shard", F.explode(F.expr("sequence(upto - draws, upto - 1)")).alias("position")))
    taken = (draws.join(runs, ["source_key", "position"])
             .groupBy("source_key", "block").agg(
                 F.array_sort(F.collect_list(F.struct(F.col("pass"), "shard"))).alias("block_draws"),
                 F.first("state").alias("state")))
    none = F.expr("cast(array() as array<struct<pass:int,shard:int>>)")
    of_block = (dealt.join(materialized(taken, "mix-draws"), ["source_key", "block"], "left")
                .join(materialized(partly, "mix-cut"), ["source_key", "doc_key"], "left"))
    drawn = F.expr("case when state = 'cut' and chosen is null then filter(block_draws, d -> d.pass < passes) else block_draws end")
    return of_block.select("doc_id", *keep, "source_key", "size", "source_size", "target", "place",
                           F.coalesce(drawn, none).alias("draws"))


def mix(docs, shards=16, seed=0, **options):
    """The mix itself: the rows of ``docs``, each as often as it is drawn, dealt to shards and shuffled
    inside them.  Columns are those of ``docs``; documents that are not drawn are not there."""
    plan = plan_mix(docs.select("doc_id", "source", "text"), shards=shards, seed=seed, **options)
    draws = plan.filter("size(draws) > 0").select(
        F.col("doc_id").alias("_id"), "source_key", "draws", "place").dropDuplicates(["_id", "source_key"])
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    rows = packed(docs, _doc=F.col("doc_id"), _source=key)
    joined = rows.join(draws, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_source") == F.col("source_key")))
    placed = joined.select("_row", F.explode("draws").alias("draw"), "place")
    turn = F.xxhash64(F.lit(seed), F.col("draw.shard"), F.col("draw.pass"), "place")
    return (placed.select("_row", turn.alias("turn"), F.col("draw.shard").alias("shard"))
            .repartition(F.col("shard")).sortWithinPartitions("shard", "turn").select("_row.*"))
