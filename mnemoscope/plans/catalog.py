"""Registry of the named queries and of the SQL each is checked against."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that must give the same rows."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register
