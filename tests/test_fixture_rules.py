import json

from builders import by_scope, mutated
from pyspark.sql import functions as F

from mnemoscope.functions import jsontype as J
from mnemoscope.operators import generate as G
from mnemoscope.operators import ledger as L
from mnemoscope.quality.fixture_rules import fixture_violations, structure
from mnemoscope.quality.framework import assert_valid
from mnemoscope.sources import fixture_json as X

import pytest


def base():
    """Three sessions: f-1 (replaced by f-2 in session 2) and f-3, with one probe of each kind."""
    sessions = [{"sessionId": f"s-{n:04d}", "timestamp": f"2025-03-0{n}T08:00:00+01:00", "turns": [
        {"turnId": f"t-{n}-{k}", "role": "user", "text": "words", "topicId": f"topic-{k}", "introducedFactIds": [],
         "referencedFactIds": []} for k in range(10)]} for n in (1, 2, 3)]
    sessions[0]["turns"][0]["introducedFactIds"] = ["f-1"]
    sessions[0]["turns"][1]["introducedFactIds"] = ["f-3"]
    sessions[1]["turns"][0].update(introducedFactIds=["f-2"], referencedFactIds=["f-1"])

    def fact(i, value, state, at, supersedes=None, ended=None, topic="topic-0"):
        return {"factId": i, "value": value, "state": state, "introducedAt": at, "supersedes": supersedes, "invalidatedAt": ended, "topicId": topic}

    def probe(i, ability, kind, answers, required, forbidden=(), distance=2, as_of="current", answerable=True, **extra):
        return {"probeId": i, "afterSessionId": "s-0003", "question": "Which?", "ability": ability, "answerability": answerable,
                "answerAsOf": as_of, "sessionDistance": distance,
                "expected": {"matchType": kind, "acceptedAnswers": answers, "requiredFactIds": list(required), "forbiddenFactIds": list(forbidden), **extra}}
    return {
        "schemaVersion": "1.0", "generatorVersion": "1.0.0", "fixtureId": "fx", "seed": 1, "sessions": sessions,
        "facts": [fact("f-1", "10", "superseded", "t-1-0", ended="t-2-0"), fact("f-2", "20.0", "active", "t-2-0", supersedes="f-1"),
                  fact("f-3", "Oslo", "active", "t-1-1", topic="topic-1")],
        "probes": [
            probe("p-1", "information-extraction", "exact", ["Oslo"], ["f-3"]),
            probe("p-2", "knowledge-update", "numeric", ["20"], ["f-2"], ["f-1"], distance=1, targetNumber="20.00", tolerance=0.5),
            probe("p-3", "cross-session-reasoning", "ordered-list", ['["20.0", "Oslo"]'], ["f-3", "f-2"]),
            probe("p-4", "temporal-reasoning", "semantic", ["ten"], ["f-1"], as_of="historical", rubric="r", requiredClaims=["c"], disallowedContradictions=[]),
            probe("p-5", "abstention", "abstain", ["I do not know."], [], distance=0, answerable=False)]}


def turn(f, n, k):
    return f["sessions"][n]["turns"][k]


CHANGES = {
    "V02": lambda f: f.update(schemaVersion="2.0"), "V03": lambda f: f.update(generatorVersion="9"),
    "V05": lambda f: f.update(contentHash="xyz"), "V06": lambda f: f["facts"][2].update(factId=" "),
    "V07": lambda f: f["probes"][4].update(probeId="f-3"), "V08": lambda f: f.update(sessions=[]),
    "V09": lambda f: f["sessions"][1].update(sessionId="s-0009"), "V11": lambda f: f["sessions"][1].update(timestamp="2025-03-02T08:00:00"),
    "V12": lambda f: f["sessions"][1].update(timestamp="2025-03-01T07:00:00Z"), "V13": lambda f: f["sessions"][2]["turns"].pop(),
    "V15": lambda f: turn(f, 0, 3).update(role="assistant"), "V16": lambda f: turn(f, 0, 3).update(text="  "),
    "V17": lambda f: turn(f, 1, 0).update(referencedFactIds=["f-1", "f-1"]), "V18": lambda f: turn(f, 0, 5).update(introducedFactIds=["f-3"]),
    "V19": lambda f: f["facts"][0].update(value=""), "V20": lambda f: f["facts"][2].update(state="gone"),
    "V21": lambda f: f["facts"][2].update(introducedAt="nowhere"), "V22": lambda f: f["facts"][2].update(introducedAt="t-1-2"),
    "V23": lambda f: f["facts"][2].update(topicId="topic-9"), "V24": lambda f: f["facts"][0].update(invalidatedAt="t-1-0"),
    "V25": lambda f: f["facts"][2].update(invalidatedAt="t-3-0"), "V26": lambda f: turn(f, 0, 5).update(introducedFactIds=["ghost"]),
    "V27": lambda f: f["facts"][1].update(supersedes="ghost"), "V28": lambda f: f["facts"][0].update(supersedes="f-2"),
    "V29": lambda f: f["facts"][2].update(supersedes="f-1"), "V30": lambda f: (f["facts"][1].update(topicId="topic-7"), turn(f, 1, 0).update(topicId="topic-7")),
    "V31": lambda f: f["facts"][0].update(invalidatedAt="t-2-5"), "V32": lambda f: f["facts"][0].update(state="expired"),
    "V33": lambda f: f["facts"][2].update(state="superseded", invalidatedAt="t-3-9"), "V34": lambda f: turn(f, 2, 0).update(referencedFactIds=["ghost"]),
    "V35": lambda f: turn(f, 0, 4).update(referencedFactIds=["f-1"]), "V36": lambda f: f["probes"][0].update(question=""),
    "V37": lambda f: f["probes"][0].update(afterSessionId="s-0099"), "V38": lambda f: f["probes"][0].update(ability="guessing"),
    "V39": lambda f: f["probes"][0].update(sessionDistance=-1), "V40": lambda f: f["probes"][0]["expected"].update(matchType="regex"),
    "V41": lambda f: f["probes"][1]["expected"].update(forbiddenFactIds=["f-1", "f-1"]), "V42": lambda f: f["probes"][4]["expected"].update(forbiddenFactIds=["f-1"]),
    "V43": lambda f: f["probes"][4].update(sessionDistance=1), "V44": lambda f: f["probes"][0]["expected"].update(requiredFactIds=[]),
    "V45": lambda f: f["probes"][1]["expected"].update(forbiddenFactIds=["f-1", "f-2"]), "V46": lambda f: f["probes"][0].update(afterSessionId="s-0001"),
    "V47": lambda f: f["probes"][0].update(sessionDistance=1), "V48": lambda f: f["probes"][3].update(answerAsOf="current"),
    "V49": lambda f: f["probes"][0]["expected"].update(forbiddenFactIds=["f-2"]), "V50": lambda f: f["probes"][1]["expected"].update(forbiddenFactIds=[]),
    "V51": lambda f: f["probes"][0].update(ability="cross-session-reasoning"), "V52": lambda f: f["probes"][0]["expected"].update(acceptedAnswers=["Bergen"]),
    "V53": lambda f: f["probes"][1]["expected"].update(acceptedAnswers=["21"]), "V54": lambda f: f["probes"][3]["expected"].update(requiredClaims=[]),
    "V55": lambda f: f["probes"][2]["expected"].update(acceptedAnswers=['["Oslo", "20.0"]']),
    "V53b": lambda f: f["probes"][1]["expected"].update(tolerance="-1"), "V53c": lambda f: f["probes"][1]["expected"].update(targetNumber="20.01"),
    "V42b": lambda f: f["probes"][4]["expected"].update(acceptedAnswers=["No idea."]),
}


def load(spark, tmp_path, values):
    """Each named document as its own fixture file, the fixture id being the name."""
    for name, text in values:
        document = json.loads(text)
        if isinstance(document, dict):
            document["fixtureId"] = name
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    return X.read_fixtures(spark, str(tmp_path))


def test_each_mutation_breaks_its_rule(spark, tmp_path):
    tables, _ = load(spark, tmp_path, mutated(base(), CHANGES))
    seen = by_scope(fixture_violations(tables))
    assert "valid" not in seen, seen["valid"]
    wrong = {name: seen.get(name) for name in CHANGES if name[:3] not in seen.get(name, set())}
    assert not wrong


def test_structure_of_documents(spark, tmp_path):
    changes = {"V01": lambda f: f.pop("facts"), "V04": lambda f: f.update(seed=True), "V14": lambda f: turn(f, 0, 0).pop("topicId"),
               "V19": lambda f: f["facts"][0].pop("supersedes"), "V36": lambda f: f["probes"][0].pop("ability"),
               "V39": lambda f: f["probes"][0].update(answerability=1), "V41": lambda f: f["probes"][0]["expected"].update(acceptedAnswers="Oslo")}
    _, documents = load(spark, tmp_path, mutated(base(), changes))
    seen = by_scope(structure(documents))
    assert "valid" not in seen and all(name in seen.get(name, set()) for name in changes), seen


def test_documents_that_are_not_strict_json_are_rejected(spark, tmp_path):
    (tmp_path / "twice.json").write_text('{"fixtureId":"a","fixtureId":"b"}')
    (tmp_path / "nan.json").write_text('{"fixtureId":NaN}')
    (tmp_path / "fine.json").write_text('{"fixtureId":"c"}')
    assert {r.file.rsplit("/", 1)[1] for r in X.rejected(spark, str(tmp_path)).collect()} == {"twice.json", "nan.json"}


def test_generated_corpora_pass_at_every_scale(spark):
    seeds = spark.createDataFrame([(42, 10), (7, 100), (8, 500), (9, 1000)], "seed long, scale int")
    assert G.seed_problems(seeds).isEmpty()
    tables = G.generate(seeds)
    assert_valid(fixture_violations(tables))
    probes = {r.fixtureId.split("-")[2]: r["count"] for r in tables.probes.groupBy("fixtureId").count().collect()}
    assert probes == {"10": 5, "100": 10, "500": 15, "1000": 20}
    recurrence = L.topic_recurrence(tables.turns).agg(F.min("recurrence").alias("m")).first().m
    assert recurrence >= 0.2


def test_generation_is_deterministic_and_depends_on_the_seed(spark):
    def text(seed):
        tables = G.generate(spark.createDataFrame([(seed, 10)], "seed long, scale int"))
        return [tuple(r) for r in tables.turns.orderBy("turnId").select("turnId", "text").collect()]
    assert text(5) == text(5) != text(6)


def test_documents_hash_over_everything_but_the_hash(spark):
    seeds = spark.createDataFrame([(3, 10)], "seed long, scale int")
    row = X.to_documents(G.generate(seeds)).first()
    from builders import digest
    document = json.loads(row.body)
    assert row.contentHash == digest(document)
    assert document["facts"][0]["supersedes"] is None and len(document["sessions"]) == 10
    parsed = spark.createDataFrame([(row.body,)], "text string").withColumn("document", J.strict(F.col("text")))
    typed = X.parse(parsed)
    assert_valid(fixture_violations(X.split_documents(typed)).unionByName(structure(typed.select("fixtureId", "document"))))


def test_seed_ranges_and_scales(spark):
    seeds = spark.createDataFrame([(-1, 10), (1_000_000_000, 10), (5, 11), (5, 10)], "seed long, scale int")
    assert G.seed_problems(seeds).count() == 3
    assert G.seed_problems(seeds.filter("seed > 5"), held_out=True).isEmpty()
    points = [r.c for r in spark.createDataFrame([(10,), (100,), (500,), (1000,)], "s int").select(G.checkpoints(F.col("s")).alias("c")).collect()]
    assert points == [[10], [11, 100], [11, 101, 500], [11, 101, 501, 1000]]


def test_fail_fast(spark):
    bad = spark.createDataFrame([("V02", "fx", "fixture", "schemaVersion")], "ruleId string, scope string, path string, detail string")
    with pytest.raises(ValueError, match="V02 fx"):
        assert_valid(bad)
