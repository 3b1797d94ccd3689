"""Line dedup with levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents that hold the
line and the largest of their ids.  A new batch of documents merge-anti-joins the runs to find the lines
that are new to the corpus, and adds its own run to level 0; when a level has ``fanout`` runs they are
merged into one run of the next level.  All runs share their buckets, so anti joins read runs in place and
only a batch's own hashes are shuffled; each hash is rewritten once per level.
"""

import uuid

from pyspark.sql import functions as F

from mnemoscope.llm.frames import packed, unpacked
from mnemoscope.llm.skew import counted_join
from mnemoscope.session import materialized, scratch_folder

HASH = ["h1", "h2"]
BLANKS = " \t\n\x0b\f\r"


def line_key(line):
    """A line with blanks stripped at both ends and A-Z in lower case."""
    blanks = F.lit(BLANKS)
    return F.translate(F.btrim(line, blanks), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_table(docs, min_chars=20):
    """The long lines of every text: doc_id, text_key, pos (from 1), and 128 bits of the line's key."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_key"),
                        F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keyed = (lines.filter(F.char_length("line") >= min_chars)
             .select("doc_id", "text_key", (F.col("at") + 1).alias("pos"), line_key("line").alias("key"))
             .filter(F.char_length("key") >= min_chars))
    return keyed.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """The levels of runs.  Their tables live in a database of their own in the shared folder."""

    def __init__(self, spark, fanout=4, buckets=None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"line_runs_{uuid.uuid4().hex}"
        self.levels = [[]]
        self.folder = scratch_folder(spark, "line-runs")
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.folder}'")

    def _write(self, frame):
        name = f"{self.database}.run_{uuid.uuid4().hex}"
        (frame.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .format("parquet").saveAsTable(name))
        return name

    def tables(self):
        return [name for level in self.levels for name in level]

    def new_lines(self, keys):
        """Hashes of a batch that no run holds yet: one merge anti join per run."""
        for name in self.tables():
            keys = keys.join(self.spark.table(name).filter("first_seen").select(*HASH), HASH, "left_anti")
        return keys

    def add(self, lines):
        """Add a batch of (h1, h2, doc_id); no document may be in two batches.  Returns the table of its run,
        in which first_seen marks lines that are new to the corpus."""
        own = (lines.select(*HASH, "doc_id").distinct().groupBy(*HASH)
               .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder")))
        if self.tables():
            own = materialized(own, "line-batch")
            new = self.new_lines(own).select(*HASH, F.lit(True).alias("first_seen"))
            own = own.join(new, HASH, "left").fillna(False, ["first_seen"])
        else:
            own = own.withColumn("first_seen", F.lit(True))
        run = self._write(own)
        self.levels[0].append(run)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._merge(self.levels[level], level + 1)
        return run

    def _merge(self, names, level):
        """Merge runs into one of another level and drop them."""
        # Read as plain files: a union of bucketed tables passes for partitioned by bucket in Spark 4.1, and
        # an aggregation on top of it would leave equal hashes apart.
        layout = self.spark.table(names[0]).schema
        files = self.spark.read.schema(layout).parquet(*[f"{self.folder}/{name.split('.')[1]}" for name in names])
        run = self._write(files.groupBy(*HASH).agg(
            F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"), F.max("first_seen").alias("first_seen")))
        for name in list(names):
            self.spark.sql(f"DROP TABLE {name}")
        for of_level in self.levels:
            of_level[:] = [name for name in of_level if name not in names]
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def compacted(self):
        """One run with the counts of everything added so far."""
        names = self.tables()
        if len(names) > 1:
            self._merge(names, len(self.levels))
        return self.spark.table(self.tables()[0])


def drop_repeated_lines(docs, min_chars=20, min_docs=3, batches=4, fanout=4):
    """Add n_lines, n_dropped and kept_text: the text without the lines that at least ``min_docs``
    documents hold, which stay only in the largest doc_id that holds them.

    A line counts by its key: blanks stripped at both ends, A-Z in lower case; keys shorter than
    ``min_chars`` code points always stay.  A null or empty text is one empty line and stays empty.  Rows with one doc_id
    are one document; a null doc_id is the smallest.  All rows and all other columns are kept.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines = materialized(line_table(slim, min_chars).withColumn("batch", batch).repartition(F.col("batch"), F.col("h1")), "lines")
    runs = LineRuns(spark, fanout)
    for number in range(batches):
        runs.add(lines.filter(F.col("batch") == number))
    repeated = runs.compacted().filter(F.col("n_docs") >= min_docs).select(*HASH, "n_docs", "holder")
    dropped = (counted_join(lines, repeated, HASH, "n_docs")
               .filter("NOT (doc_id <=> holder)").groupBy("doc_id", "text_key")
               .agg(F.collect_set("pos").alias("gone")))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "gone")
    rows = packed(docs, _text=F.coalesce("text", F.lit("")), _doc=F.col("doc_id"))
    keyed = rows.withColumn("_text_key", F.xxhash64("_text"))
    joined = keyed.join(dropped, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    parts = F.split("_text", "\n", -1)
    kept = F.array_join(F.expr(r"transform(array_except(sequence(1, size(_lines)), gone), p -> _lines[p - 1])"), "\n")
    rows = joined.withColumn("_lines", parts)
    return unpacked(rows, docs.columns, n_lines=F.size("_lines").cast("bigint"),
                    n_dropped=F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"),
                    kept_text=F.when(F.col("gone").isNull(), F.col("_text")).otherwise(kept))
