"""Registry of this subpackage's queries and of the SQL each is checked against."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that must give the same rows."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def conversations(spark, folder):
    return spark.read.parquet(f"{folder}/conversations.parquet")


def benchmark(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")
