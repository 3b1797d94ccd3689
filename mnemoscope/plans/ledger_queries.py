"""Fact-ledger queries over the order history."""

from pyspark.sql import functions as F

from mnemoscope.operators import ledger as L
from mnemoscope.plans.catalog import query
from mnemoscope.sources import tables as T

LEDGER = """
WITH monthly AS (SELECT o_custkey AS "topicId", (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS session, o_orderpriority AS value,
  o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
ev AS (SELECT "topicId" // 100 AS "fixtureId", "topicId", session, value, CASE WHEN status = 'P' THEN 'expire' ELSE 'plant' END AS kind FROM monthly WHERE rn = 1),
seq AS (SELECT *, lag(kind) OVER w AS pk, lag(session) OVER w AS ps, lead(kind) OVER w AS nk, lead(session) OVER w AS ns FROM ev
  WINDOW w AS (PARTITION BY "topicId" ORDER BY session)),
ledger AS (SELECT "fixtureId", "topicId", value, session AS "introSession", 1 AS "introTurn", CASE WHEN pk = 'plant' THEN ps END AS "supersedesSession",
  ns AS "invalidSession", CASE WHEN ns IS NOT NULL THEN 1 END AS "invalidTurn",
  CASE nk WHEN 'plant' THEN 'superseded' WHEN 'expire' THEN 'expired' ELSE 'active' END AS state FROM seq WHERE kind = 'plant'),
points AS (SELECT DISTINCT o_custkey // 100 AS "fixtureId", (year(o_orderdate) - 1991) * 12 AS checkpoint FROM orders)
"""


def ledger(spark, folder):
    return L.build_ledger(T.fact_events(spark, folder))


@query("w03_ledger", LEDGER + "SELECT * FROM ledger")
def w03(spark, folder):
    return ledger(spark, folder)


@query("w04_misplaced_events", LEDGER + """SELECT "fixtureId", "topicId", session, 1 AS turn, value, kind, 'expiry without a current fact' AS detail
 FROM seq WHERE kind = 'expire' AND coalesce(pk, '') <> 'plant'""")
def w04(spark, folder):
    return L.misplaced_events(T.fact_events(spark, folder))


@query("j07_facts_at_checkpoints", LEDGER + """SELECT checkpoint, state, count(*) AS facts, count(DISTINCT value) AS "values"
 FROM ledger JOIN points USING ("fixtureId") WHERE "introSession" <= checkpoint AND ("invalidSession" IS NULL OR "invalidSession" > checkpoint) GROUP BY 1, 2""")
def j07(spark, folder):
    rows = L.facts_at_checkpoints(ledger(spark, folder), T.checkpoints(spark, folder))
    return rows.groupBy("checkpoint", "state").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("value").alias("values"))


@query("w10_current_values", LEDGER + """SELECT "fixtureId", "topicId", checkpoint, arg_max(value, "introSession") AS value, max("introSession") AS "introSession"
 FROM ledger JOIN points USING ("fixtureId") WHERE "introSession" <= checkpoint AND ("invalidSession" IS NULL OR "invalidSession" > checkpoint) GROUP BY 1, 2, 3""")
def w10(spark, folder):
    return L.current_values(ledger(spark, folder), T.checkpoints(spark, folder))


def _facts(spark, folder):
    name = F.concat_ws("-", "topicId", "introSession")
    older = F.when(F.col("supersedesSession").isNotNull(), F.concat_ws("-", "topicId", "supersedesSession"))
    return ledger(spark, folder).select("fixtureId", "topicId", "value", name.alias("factId"), older.alias("supersedes"))


@query("j06_supersession", LEDGER + """SELECT n."topicId", n."introSession", n.value, o.value AS "oldValue", o.state AS "oldState"
 FROM ledger n JOIN ledger o ON o."topicId" = n."topicId" AND o."introSession" = n."supersedesSession" """)
def j06(spark, folder):
    rows = ledger(spark, folder)
    old = rows.select("topicId", F.col("introSession").alias("supersedesSession"), F.col("value").alias("oldValue"),
                      F.col("state").alias("oldState"))
    return rows.join(old, ["topicId", "supersedesSession"]).select("topicId", "introSession", "value", "oldValue", "oldState")


CHAINS = LEDGER.replace("WITH monthly", "WITH RECURSIVE monthly") + """,
 fact AS (SELECT "fixtureId", "topicId", "topicId" || '-' || "introSession" AS "factId", CASE WHEN "supersedesSession" IS NOT NULL THEN "topicId" || '-' || "supersedesSession" END AS supersedes FROM ledger),
 chain AS (SELECT "fixtureId", "topicId", "factId", "factId" AS root, 0 AS depth FROM fact WHERE supersedes IS NULL
  UNION ALL SELECT f."fixtureId", f."topicId", f."factId", c.root, c.depth + 1 FROM fact f JOIN chain c ON f.supersedes = c."factId")
"""


@query("j06_chain_positions", CHAINS + """SELECT "fixtureId", "factId", root, CAST(depth AS BIGINT) AS depth FROM chain""")
def j06_chains(spark, folder):
    return L.chain_positions(_facts(spark, folder))


@query("u07_ancestor_chains", CHAINS + """, req AS (SELECT "fixtureId", "topicId" AS "probeId", "topicId" || '-' || max("introSession") AS "factId" FROM ledger GROUP BY 1, 2),
 forb AS (SELECT "fixtureId", "topicId" AS "probeId", "topicId" || '-' || "introSession" AS "factId" FROM ledger WHERE state = 'superseded'),
 a AS (SELECT r."fixtureId", r."probeId", c.root, c.depth FROM req r JOIN chain c USING ("factId")),
 b AS (SELECT f."fixtureId", f."probeId", count(*) AS n, count(*) FILTER (a.root IS NOT NULL AND c.depth < a.depth) AS below FROM forb f JOIN chain c USING ("factId")
  LEFT JOIN a ON a."probeId" = f."probeId" AND a.root = c.root GROUP BY 1, 2)
 SELECT a."fixtureId", a."probeId", CAST(a.depth AS BIGINT) AS ancestors, coalesce(n, 0) AS forbidden,
 a.depth > 0 AND a.depth = coalesce(n, 0) AND coalesce(n, 0) = coalesce(below, 0) AS exact FROM a LEFT JOIN b USING ("fixtureId", "probeId")""")
def u07(spark, folder):
    rows = ledger(spark, folder)
    name = F.concat_ws("-", "topicId", "introSession")
    required = rows.groupBy("fixtureId", "topicId").agg(F.max("introSession").alias("introSession")).select(
        "fixtureId", F.col("topicId").alias("probeId"), name.alias("factId"))
    forbidden = rows.filter("state = 'superseded'").select("fixtureId", F.col("topicId").alias("probeId"), name.alias("factId"))
    return L.ancestors_match(required, forbidden, L.chain_positions(_facts(spark, folder)))


@query("a22_topic_recurrence", """SELECT *, CAST(recurring AS DOUBLE) / topics AS recurrence FROM (SELECT "fixtureId", count(*) AS topics, count(*) FILTER (s > 1) AS recurring FROM (
 SELECT o_custkey // 100 AS "fixtureId", o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS s FROM orders GROUP BY 1, 2) GROUP BY 1)""")
def a22(spark, folder):
    visits = T.table(spark, folder, "orders").select(
        F.expr("o_custkey div 100").alias("fixtureId"), F.col("o_custkey").alias("topicId"),
        F.date_trunc("month", "o_orderdate").alias("sessionId"))
    return L.topic_recurrence(visits)
