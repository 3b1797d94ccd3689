"""A table that a stream's batches add to, merged level by level so that reading it opens few folders.

Every batch writes one folder at level 0; ``fanout`` folders of a level are merged into one of the next.  After m
batches the folders that count follow from the digits of m to the base ``fanout``: at most fanout - 1 of each of
log(m) levels.  All folders are named by numbers, so a batch that is tried again writes the same ones again; what a
merge has consumed is emptied by the next batch, when nobody can need it for another try.
"""

FANOUT = 8


class Levels:
    """merge: a function from a DataFrame to one with the same columns, that may be applied to parts first."""

    def __init__(self, spark, folder, merge, fanout=FANOUT):
        self.spark, self.folder, self.merge, self.fanout = spark, folder, merge, fanout

    def _run(self, level, number):
        return f"{self.folder}/level-{level}/run-{number}"

    def _merges(self, batches):
        """(level, number, consumed folders) of the merges that follow the last of so many batches."""
        level, number = 0, batches
        while number and number % self.fanout == 0:
            parts = [self._run(level, i) for i in range(number - self.fanout + 1, number + 1)]
            level, number = level + 1, number // self.fanout
            yield level, number, parts

    def live(self, batches):
        """Folders that hold the table after so many batches."""
        folders, level, number = [], 0, batches
        while number:
            folders += [self._run(level, i) for i in range(number - number % self.fanout + 1, number + 1)]
            level, number = level + 1, number // self.fanout
        return folders

    def batches(self):
        """How many batches have been added; the last two numbers are kept, in turns."""
        path = f"{self.folder}/progress"
        found = self.spark.read.schema("batches bigint").parquet(f"{path}/slot-*").groupBy().max("batches").first()[0]
        return found or 0

    def add(self, rows, number):
        """Add the rows of batch ``number``, counted from 0."""
        schema = rows.schema
        for _, _, consumed in self._merges(number):
            for folder in consumed:
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
        count = number + 1
        self.merge(rows).write.mode("overwrite").parquet(self._run(0, count))
        for level, run, parts in self._merges(count):
            self.merge(self.spark.read.schema(schema).parquet(*parts)).write.mode("overwrite").parquet(self._run(level, run))
        self.spark.createDataFrame([(count,)], "batches bigint").write.mode("overwrite").parquet(f"{self.folder}/progress/slot-{count % 2}")

    def before(self, number, schema):
        """The table as batch ``number`` finds it, also when that batch is tried again."""
        folders = self.live(number)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.merge(self.spark.read.schema(schema).parquet(*folders))

    def read(self):
        """The table as of the last batch."""
        return self.merge(self.spark.read.parquet(*self.live(self.batches())))
