"""Joins to a lookup that knows how many rows hold each of its keys."""

from pyspark.sql import functions as F

HOT_SHARE = 1000


def counted_join(rows, lookup, keys, count):
    """Inner join of rows to a lookup with one row per key and the number of rows of each key.

    Keys that hold more than 1 / HOT_SHARE of all counted rows are fewer than HOT_SHARE, so their lookup rows
    are broadcast and their rows stay where they are; the others are shuffled by key.  Both should be read
    from files, as each is read twice.
    """
    total = lookup.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = lookup.filter(is_hot)
    warm = rows.join(F.broadcast(hot), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(lookup.filter(~is_hot), keys)
    return warm.unionByName(cold)
