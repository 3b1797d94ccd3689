"""Fixture documents: reading many JSON files, writing documents and the two published views."""

from pyspark.sql import functions as F

from mnemoscope import schemas
from mnemoscope.functions import jsontype as J
from mnemoscope.functions.canonical import canonical_json
from mnemoscope.operators.fixtures import agent_documents, split_documents


def read_documents(spark, path):
    """(file, text, document VARIANT) of whole JSON documents; document is NULL for JSON that is not
    strict."""
    rows = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.withColumn("document", J.strict(F.col("text")))


def parse(documents):
    """Typed fixture documents; tolerance and targets arrive as number or text alike."""
    typed = F.from_json("text", schemas.struct(schemas.FIXTURE))
    return documents.filter("document IS NOT NULL").select(F.col("document"), typed.alias("f")).select("document", "f.*")


def read_fixtures(spark, path):
    """Fixture tables of all documents under a path, plus (fixtureId, document) for structure rules."""
    typed = parse(read_documents(spark, path))
    return split_documents(typed), typed.select("fixtureId", "document")


def rejected(spark, path):
    """Files that are no strict JSON."""
    return read_documents(spark, path).filter("document IS NULL").select("file")


def to_documents(tables):
    """One nested document per fixture with its content hash.

    A fixture holds at most a thousand sessions of ten turns, so its document fits one row.
    """
    turn = F.struct("turnId", "role", "text", "introducedFactIds", "referencedFactIds", "topicId")
    turns = tables.turns.groupBy("fixtureId", "sessionIndex").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turnIndex", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    session = F.struct("sessionId", "timestamp", "turns")
    sessions = (tables.sessions.join(turns, ["fixtureId", "sessionIndex"], "left").groupBy("fixtureId").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sessionIndex", session.alias("s")))), lambda x: x["s"]).alias("sessions")))
    fact = F.struct("factId", "value", "state", "introducedAt", "supersedes", "invalidatedAt", "topicId")
    facts = tables.facts.groupBy("fixtureId").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("factIndex", fact.alias("f")))), lambda x: x["f"]).alias("facts"))
    probe = F.struct("probeId", "afterSessionId", "question", "ability", "answerability", "answerAsOf",
                     "sessionDistance", "expected")
    probes = tables.probes.groupBy("fixtureId").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("probeIndex", probe.alias("p")))), lambda x: x["p"]).alias("probes"))
    rows = (tables.fixtures.drop("contentHash", "sessionCount").join(sessions, "fixtureId", "left")
            .join(facts, "fixtureId", "left").join(probes, "fixtureId", "left"))
    # supersedes and invalidatedAt are fields even when null, absent answer settings are not.
    body = F.to_json(F.struct(
        "schemaVersion", "generatorVersion", "fixtureId", "seed", "sessions",
        F.transform("facts", lambda f: F.map_from_entries(F.array(*[
            F.struct(F.lit(n).alias("key"), f[n].alias("value")) for n in (
                "factId", "value", "state", "introducedAt", "supersedes", "invalidatedAt", "topicId")]))).alias("facts"),
        "probes"))
    return rows.withColumn("body", body).withColumn("contentHash", F.sha2(canonical_json(F.col("body")), 256))


def write_split(documents, agent_path, scorer_path):
    """Publish the agent-facing and the scorer-facing form of each fixture at two places."""
    agent_documents(documents).write.mode("errorifexists").json(agent_path)
    documents.select("body", "contentHash", "fixtureId").write.mode("errorifexists").json(scorer_path)
