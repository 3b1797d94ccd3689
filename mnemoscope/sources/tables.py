"""Evaluation tables derived from a warehouse of orders, events, customers and texts.

The warehouse holds no fixtures or runs, so each entity is stated as an expression over whole tables:
a user's event log is a run, an event that is not a view is a probe, and so on.
"""

from pyspark.sql import functions as F

ABILITIES = ("information-extraction", "cross-session-reasoning", "temporal-reasoning",
             "knowledge-update", "abstention")


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows, *keys):
    """Rows dealt to as many tasks as the session shuffles to, or has cores, however small the files they come from.

    A table in one row group is read by one task, and adaptive execution joins shuffled parts by their bytes; where a row
    costs much time, or is widened afterwards, either leaves too few tasks.  With keys, equal ones stay together.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys)


def requests(spark, folder):
    """Every event is one archived model request of the run of its user."""
    k = F.get_json_object("props", "$.k").cast("int")
    total = F.floor(F.col("value") * 100).cast("bigint")
    failed = F.col("event_type") == "error"
    category = (F.when(k < 25, "budget").when(k < 50, "provider").when(k < 75, "adapter")
                .otherwise("timeout"))
    probe = F.col("event_type") != "view"
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.col("ts"), k.alias("k"), "event_type",
        F.concat(F.lit("run-"), F.col("user_id")).alias("runId"),
        F.concat(F.lit("fx-"), F.expr("user_id div 10")).alias("fixtureId"),
        F.concat(F.lit("r-"), F.col("event_id")).alias("requestId"),
        F.when(probe, F.concat(F.lit("p-"), F.col("event_id"))).alias("probeId"),
        F.when(~probe, F.concat(F.lit("t-"), F.col("event_id"))).alias("turnId"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, category).alias("category"),
        (F.col("value") * 2).alias("latencyMs"),
        (total + 12).alias("totalTokens"),
        F.struct((F.lit(0) + F.expr("cast(floor(value * 100) as bigint) div 4")).alias("stable"),
                 F.expr("cast(floor(value * 100) as bigint) div 3").alias("semi-stable"),
                 F.expr("cast(floor(value * 100) as bigint) div 5").alias("unstable")).alias("tierTokens"),
        F.lit(12).cast("bigint").alias("requestOverheadTokens"),
        "value")


def gold(spark, folder):
    """Gold probes: the ability follows the hour, evidence grows with the value."""
    ability = F.element_at(F.array(*[F.lit(a) for a in ABILITIES]),
                           (F.expr("hour(ts) div 5") + 1).cast("int"))
    evidence = F.when(F.col("value") < 20, 1).when(F.col("value") < 100, 2).otherwise(3)
    rows = requests(spark, folder).filter("probeId IS NOT NULL").withColumn("ability", ability)
    unanswerable = F.col("ability") == "abstention"
    return rows.select(
        "runId", "fixtureId", "probeId", "seq", "ts", "k", "event_type", "value", "ability",
        (~unanswerable).alias("answerability"),
        F.dayofmonth("ts").alias("sessionDistance"),
        F.when(unanswerable, 0).otherwise(evidence).alias("evidenceCardinality"))


def captured(spark, folder):
    """Attempted probes: all but cheap sign-ups, which stand for probes a run never reached."""
    attempted = ~((F.col("event_type") == "signup") & (F.col("value") < 5))
    rows = requests(spark, folder).filter("probeId IS NOT NULL").filter(attempted)
    return rows.select("runId", "probeId", "seq", "status", "category", "latencyMs", "requestId",
                       (F.col("status") == "ok").alias("eligibleForAccuracy"),
                       F.when(F.col("status") == "ok", F.concat(F.lit("answer "), "k")).alias("answer"))


def scores(spark, folder):
    """Judgments: 10 % abstain, 60 % pass, 30 % fail, incomplete when not answered."""
    rows = gold(spark, folder)
    answered = (F.col("event_type") != "error") & ~(
        (F.col("event_type") == "signup") & (F.col("value") < 5))
    judged = (F.when(~answered, "incomplete").when(F.col("k") < 10, "abstain")
              .when(F.col("k") < 70, "pass").otherwise("fail"))
    correct = ((F.col("judgment") == "pass") & F.col("answerability")) | (
        (F.col("judgment") == "abstain") & ~F.col("answerability"))
    return (rows.withColumn("judgment", judged).withColumn("correct", correct)
            .select("runId", "probeId", "judgment", "correct", answered.alias("eligibleForAccuracy")))


def fact_events(spark, folder):
    """Ledger events: the last order of each customer and month plants its priority as the value, a
    pending one expires the current value.  Fixtures are ranges of customers."""
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    last = F.max_by(F.struct(F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("status")),
                    F.struct("o_orderdate", "o_orderkey"))
    rows = (table(spark, folder, "orders")
            .groupBy(F.col("o_custkey").alias("topicId"), month.alias("session")).agg(last.alias("e")))
    return rows.select(F.expr("topicId div 100").alias("fixtureId"), "topicId", "session",
                       F.lit(1).alias("turn"), "e.value",
                       F.when(F.col("e.status") == "P", "expire").otherwise("plant").alias("kind"))


def checkpoints(spark, folder):
    """Probe checkpoints: the year ends each fixture has orders in."""
    return (table(spark, folder, "orders").select(
        F.expr("o_custkey div 100").alias("fixtureId"),
        ((F.year("o_orderdate") - 1991) * 12).alias("checkpoint")).distinct())
