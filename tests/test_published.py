import pytest
from pyspark.sql import functions as F

from mnemoscope.sources import published as P

ROWS = "identity string, v int, _other string"


def seen(spark, path):
    return sorted((r.identity, r.v) for r in P.published(spark, path).collect())


def test_first_attempt_owns_an_identity(spark, tmp_path):
    path = str(tmp_path / "store")
    assert P.publish_audited(spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), (None, 5, "x")], ROWS), path).collect() == [(None, "no identity")]
    P.publish_audited(spark.createDataFrame([("a", 9, "x"), ("b", 3, None)], ROWS), path)
    assert seen(spark, path) == [("a", 1), ("a", 1), ("b", 3)]
    assert P.damaged(spark, path).isEmpty()


def test_an_identity_short_of_rows_stays_unseen_and_may_come_again(spark, tmp_path):
    path = str(tmp_path / "store")
    expected = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "identity string, rows bigint")
    given = spark.createDataFrame([("a", 1, "x"), ("b", 3, "x"), ("d", 4, "x")], ROWS)
    refused = {r.identity: r.reason for r in P.publish_audited(given, path, expected).collect()}
    assert refused == {"a": "another number of rows than expected", "c": "no rows were written", "d": "unexpected identity"}
    assert seen(spark, path) == [("b", 3)]
    P.publish_audited(spark.createDataFrame([("a", 1, "x"), ("a", 2, "x")], ROWS), path, expected.filter("identity = 'a'"))
    assert seen(spark, path) == [("a", 1), ("a", 2), ("b", 3)]


def test_a_killed_attempt_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "store")
    boom = F.udf(lambda v: 1 // (v - 7) and v, "int")
    rows = spark.range(8).select(F.lit("a").alias("identity"), boom(F.col("id").cast("int")).alias("v"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        P.publish_audited(rows, path)
    # Rows of an attempt that wrote everything and was killed before it named them.
    spark.createDataFrame([("a", 1, "x")], ROWS).write.parquet(f"{path}/rows/_attempt=aunnamed")
    assert P.identities(spark, path).isEmpty()
    P.publish_audited(spark.createDataFrame([("a", 2, "x")], ROWS), path)
    assert seen(spark, path) == [("a", 2)]


def test_two_attempts_at_once_and_damage(spark, tmp_path):
    path = str(tmp_path / "store")
    P.publish_audited(spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], ROWS), path)
    other = str(tmp_path / "other")
    P.publish_audited(spark.createDataFrame([("a", 8, "x")], ROWS), other)
    for part in ("rows", "index"):
        for folder in (tmp_path / "other" / part).iterdir():
            folder.rename(tmp_path / "store" / part / folder.name)
    first = min(f.name for f in (tmp_path / "store" / "rows").iterdir())
    assert len(seen(spark, path)) == 2 and P.identities(spark, path).count() == 2
    owner = P.identities(spark, path).filter("identity = 'b'").first()._attempt
    spark.createDataFrame([("b", 5, "x")], ROWS).write.mode("append").parquet(f"{path}/rows/_attempt={owner}")
    assert [r.identity for r in P.damaged(spark, path).collect()] == ["b"] and first.startswith("_attempt=a")


def test_nothing_to_publish(spark, tmp_path):
    path = str(tmp_path / "store")
    assert P.publish_audited(spark.createDataFrame([], ROWS), path).isEmpty()
    assert P.published(spark, path).isEmpty() and P.damaged(spark, path).isEmpty()
