from builders import by_scope, mutated, native_request
from pyspark.sql import functions as F

from mnemoscope.functions import jsontype as J
from mnemoscope.quality import envelope_rules as E


def variants(spark, rows):
    return spark.createDataFrame(rows, "key string, text string").select("key", J.strict(F.col("text")).alias("request"))


def test_each_request_mutation_breaks_its_rule(spark):
    changes = {
        "E01": lambda r: r.update(extra=1), "E01b": lambda r: r.update(requestId=""),
        "E02": lambda r: r["model"].update(version=7), "E03": lambda r: r.update(seed=True),
        "E04": lambda r: r.update(messages=[]), "E05": lambda r: r["messages"][0].update(role="root"),
        "E05b": lambda r: r["messages"][1].pop("content"), "E06": lambda r: r["messages"][0].update(content=None),
        "E06b": lambda r: r["messages"][1].update(content=[{"type": "text", "text": 1}]),
        "E07": lambda r: r["messages"][2]["toolCalls"].append(r["messages"][2]["toolCalls"][0]),
        "E08": lambda r: r["messages"][3].update(toolCallId="other"),
        "E08b": lambda r: r["messages"].insert(0, r["messages"].pop(3)),
        "E09": lambda r: r["toolCalls"][0].update(arguments={"q": "milk"}),
        "E10": lambda r: r["toolResults"][0].update(result={"found": 3}),
        "E11": lambda r: r["tools"].append(dict(r["tools"][0])), "E12": lambda r: r["tierSegments"][0].update(tier="other"),
        "E12b": lambda r: r["tierSegments"][0].update(tokenCount=True), "E13": lambda r: r["tierSegments"][1].update(sourceIds=[""]),
        "E14": lambda r: r["tierSegments"][1].update(messageIndices=[9]),
        "E14b": lambda r: r["tierSegments"][0].pop("messageIndices"),
    }
    rows = variants(spark, mutated(native_request(), changes))
    seen = by_scope(E.request_violations(rows, "key"))
    assert "valid" not in seen
    for name in changes:
        assert name[:3] in seen.get(name, set()), (name, seen.get(name))


def test_tool_result_may_not_come_before_its_call_nor_twice(spark):
    def twice(r):
        r["messages"].append(dict(r["messages"][3]))
    seen = by_scope(E.request_violations(variants(spark, mutated(native_request(), {"twice": twice})), "key"))
    assert "E08" in seen["twice"]


def test_attribution_prefix_and_pinning(spark):
    changes = {
        "missing": lambda r: r["tierSegments"][1].update(messageIndices=[1, 2]),
        "double": lambda r: r["tierSegments"][1].update(messageIndices=[0, 1, 2, 3]),
        "tool": lambda r: r["tierSegments"][1].pop("toolNames"),
        "prefix": lambda r: r["messages"][0].update(content="changed"),
        "order": lambda r: r["tierSegments"].reverse(),
    }
    rows = variants(spark, mutated(native_request(), changes)).withColumn("stablePrefix", F.array(F.lit("rules")))
    seen = by_scope(E.attribution_violations(rows, "key"))
    assert set(seen) == set(changes)
    pins = {"seed": lambda r: r.pop("seed"), "decoding": lambda r: r.update(decodingSettings={}),
            "model": lambda r: r["model"].update(name="x")}
    model = F.parse_json(F.lit('{"seed":5,"decoding":{"temperature":0},"version":"v1","name":"m","provider":"p"}'))
    rows = variants(spark, mutated(native_request(), pins)).withColumn("model", model)
    assert set(by_scope(E.pinning_violations(rows, "key"))) == set(pins)


def test_responses(spark):
    valid = {"content": None, "finishReason": "stop", "usage": {"promptTokens": 1, "completionTokens": 0}, "modelVersion": "v"}
    changes = {
        "nocontent": lambda r: r.pop("content"), "finish": lambda r: r.update(finishReason=""),
        "usage": lambda r: r["usage"].update(promptTokens=-1), "bool": lambda r: r["usage"].update(promptTokens=True),
        "extra": lambda r: r.update(x=1), "version": lambda r: r.update(modelVersion=""),
        "calls": lambda r: r.update(toolCalls=[{"id": "", "name": "a", "arguments": {}}])}
    rows = variants(spark, mutated(valid, changes)).withColumnRenamed("request", "response")
    assert set(by_scope(E.response_violations(rows, "key"))) == set(changes)


def test_agent_inputs(spark):
    turn = {"turnId": "t", "role": "user", "text": "x", "sessionId": "s"}
    changes = {"gold": lambda t: t.update(expected={}), "role": lambda t: t.update(role="assistant"),
               "text": lambda t: t.update(text=""), "session": lambda t: t.update(sessionId=4)}
    rows = variants(spark, mutated(turn, changes)).withColumnRenamed("request", "value")
    assert set(by_scope(E.input_violations(rows, "key", "turn"))) == set(changes)
