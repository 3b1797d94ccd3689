"""Whole rows beside computed columns, whatever the rows' own columns are called."""

from pyspark.sql import functions as F


def packed(docs, **columns):
    """The row as one struct ``_row`` and the given columns."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(frame, columns, **new):
    """The packed rows' ``columns``, then the new ones, which replace columns of their names."""
    return frame.select(*[F.col("_row")[c].alias(c) for c in columns if c not in new],
                        *[c.alias(name) for name, c in new.items()])
