"""Rules E01 to E18: the native request and response envelope, its attribution and its pinned model.

A request's messages, calls and segments are arrays of its own row and are bounded by the token
budget, so every rule is an expression over one row.
"""

from pyspark.sql import functions as F

from mnemoscope.functions import jsontype as J
from mnemoscope.functions.ratio import holds
from mnemoscope.quality.framework import flag

# Field names and domains of the envelope.
REQUEST_FIELDS = ("requestId", "messages", "tools", "toolCalls", "toolResults", "tierSegments", "model",
                  "decodingSettings", "seed", "tierTokens", "totalTokens", "requestOverheadTokens",
                  "stablePrefixHash")
RESPONSE_FIELDS = ("content", "toolCalls", "finishReason", "usage", "modelVersion")
ROLES = ("system", "user", "assistant", "tool")
TIERS = ("stable", "semi-stable", "unstable")
INPUT_FIELDS = {"turn": ("turnId", "sessionId", "role", "text"), "probe": ("probeId", "question")}


def _text(value, path):
    return J.at(value, path, "string")


def _named(value, path):
    """A nonempty JSON string."""
    return J.is_type(J.at(value, path), "STRING") & (_text(value, path) != "")


def _count(value, path):
    """A nonnegative JSON integer."""
    return J.is_type(J.at(value, path), "INTEGER") & (J.at(value, path, "bigint") >= 0)


def _absent_or(value, path, condition):
    return J.at(value, path).isNull() | condition


def _calls_ok(calls):
    """Well-formed tool calls with ids unique in their list; NULL calls are not a list."""
    one = F.forall(calls, lambda c: J.only_keys(c, ("id", "name", "arguments")) & _named(c, "$.id")
                   & _named(c, "$.name") & J.is_type(J.at(c, "$.arguments"), "OBJECT"))
    ids = F.transform(calls, lambda c: _text(c, "$.id"))
    return holds(one) & holds(F.size(F.array_distinct(ids)) == F.size(ids))


def _content_ok(content, allow_null):
    parts = F.forall(J.elements(content), lambda p: _named(p, "$.type") & (
        (_text(p, "$.type") != "text") | J.is_type(J.at(p, "$.text"), "STRING")))
    return (J.is_type(content, "STRING") | (J.is_type(content, "NULL") & allow_null)
            | holds((F.size(J.elements(content)) > 0) & parts))


def _same(left, right):
    return F.to_json(left) == F.to_json(right)


def _strings(values):
    return holds(F.forall(values, lambda v: J.is_type(v, "STRING") & (v.try_cast("string") != "")))


def unpack(rows, request="request"):
    """Add the arrays that several rules look at: messages, their calls and results, tools, segments."""
    r = F.col(request)
    message = F.transform(J.elements(r, "$.messages"), lambda m, i: F.struct(
        i.alias("i"), m.alias("v"), _text(m, "$.role").alias("role"), J.at(m, "$.content").alias("content"),
        J.elements(m, "$.toolCalls").alias("calls"), J.at(m, "$.toolCalls").isNotNull().alias("hasCalls"),
        _text(m, "$.toolCallId").alias("callId"), J.at(m, "$.toolCallId").isNotNull().alias("hasCallId")))
    rows = rows.withColumn("_messages", message)
    calls = F.flatten(F.transform("_messages", lambda m: F.transform(
        F.coalesce(m["calls"], F.array().cast("array<variant>")),
        lambda c: F.struct(_text(c, "$.id").alias("id"), m["i"].alias("i"), c.alias("v")))))
    names = F.transform(J.elements(r, "$.tools"), lambda t: _text(t, "$.name"))
    return (rows.withColumn("_calls", calls)
            .withColumn("_results", F.filter("_messages", lambda m: m["role"] == "tool"))
            .withColumn("_tools", F.coalesce(names, F.array().cast("array<string>")))
            .withColumn("_segments", J.elements(r, "$.tierSegments")))


def _linked_result(entry):
    """The content a top-level result must equal: parsed when the result is no string."""
    own = F.filter("_results", lambda m: m["callId"] == _text(entry, "$.toolCallId"))
    content = F.get(own, F.lit(0))["content"]
    parsed = F.coalesce(J.strict(content.try_cast("string")), content)
    wanted = J.at(entry, "$.result")
    use = F.when(~J.is_type(wanted, "STRING") & J.is_type(content, "STRING"), parsed).otherwise(content)
    return holds(F.size(own) > 0) & holds(_same(use, wanted))


def request_violations(rows, key, request="request"):
    """Violations of E01 to E14 over VARIANT requests."""
    r = F.col(request)
    rows = unpack(rows, request)
    messages, calls, results = F.col("_messages"), F.col("_calls"), F.col("_results")
    segments, tools = F.col("_segments"), F.col("_tools")
    call_ids = F.transform(calls, lambda c: c["id"])
    result_ids = F.transform(results, lambda m: m["callId"])
    top_calls, top_results = J.elements(r, "$.toolCalls"), J.elements(r, "$.toolResults")
    top_ids = F.transform(top_results, lambda e: _text(e, "$.toolCallId"))
    tool_list = J.elements(r, "$.tools")

    def attributed(s):
        indices, names = J.elements(s, "$.messageIndices"), J.elements(s, "$.toolNames")
        in_range = F.forall(indices, lambda i: J.is_type(i, "INTEGER") & i.try_cast("bigint").between(0, F.size(messages) - 1))
        known = F.forall(names, lambda n: F.array_contains(tools, n.try_cast("string")))
        some = (F.coalesce(F.size(indices), F.lit(0)) > 0) | (F.coalesce(F.size(names), F.lit(0)) > 0)
        return (_absent_or(s, "$.messageIndices", holds(in_range)) & _absent_or(s, "$.toolNames", holds(known)) & some)

    return flag(rows, key, F.coalesce(_text(r, "$.requestId"), F.lit("request")), [
        ("E01", J.only_keys(r, REQUEST_FIELDS) & _named(r, "$.requestId"), "request: fields or requestId"),
        ("E02", J.is_type(J.at(r, "$.model"), "OBJECT") & _named(r, "$.model.version")
         & J.is_type(J.at(r, "$.decodingSettings"), "OBJECT"), "model or decodingSettings: expected objects"),
        ("E03", _absent_or(r, "$.seed", J.is_type(J.at(r, "$.seed"), "INTEGER")), "seed: expected integer"),
        ("E04", F.size(messages) > 0, "messages: expected nonempty list"),
        ("E05", F.forall(messages, lambda m: J.only_keys(m["v"], ("role", "content", "toolCalls", "toolCallId"))
                         & m["role"].isin(*ROLES) & m["content"].isNotNull()), "messages: fields, role or content"),
        ("E06", F.forall(messages, lambda m: _content_ok(
            m["content"], (m["role"] == "assistant") & holds(F.size(m["calls"]) > 0))), "messages: content"),
        ("E07", F.forall(messages, lambda m: ~m["hasCalls"] | ((m["role"] == "assistant") & _calls_ok(m["calls"])))
         & (F.size(F.array_distinct(call_ids)) == F.size(calls)), "messages: tool calls"),
        ("E08", F.forall(messages, lambda m: F.when(m["role"] == "tool", F.exists(
            calls, lambda c: (c["id"] == m["callId"]) & (c["i"] < m["i"]))).otherwise(~m["hasCallId"]))
         & (F.size(F.array_distinct(result_ids)) == F.size(results)), "messages: tool result without one preceding call"),
        ("E09", _absent_or(r, "$.toolCalls", _calls_ok(top_calls) & holds(F.forall(top_calls, lambda t: F.exists(
            calls, lambda c: _same(c["v"], t))))), "toolCalls differ from those of the messages"),
        ("E10", _absent_or(r, "$.toolResults", holds(F.forall(top_results, lambda e: J.only_keys(e, ("toolCallId", "result"))
                                                             & _named(e, "$.toolCallId") & J.at(e, "$.result").isNotNull()
                                                             & _linked_result(e)))
                           & holds(F.size(F.array_distinct(top_ids)) == F.size(top_ids))),
         "toolResults differ from those of the messages"),
        ("E11", _absent_or(r, "$.tools", holds(F.forall(tool_list, lambda t: J.only_keys(t, ("name", "description", "parameters"))
                                                        & _named(t, "$.name") & J.is_type(J.at(t, "$.description"), "STRING")
                                                        & J.is_type(J.at(t, "$.parameters"), "OBJECT")))
                           & holds(F.size(F.array_distinct(tools)) == F.size(tools))), "tools: fields, types or duplicate names"),
        ("E12", (F.size(segments) > 0) & F.forall(segments, lambda s: J.only_keys(
            s, ("tier", "content", "tokenCount", "sourceIds", "messageIndices", "toolNames"))
            & _text(s, "$.tier").isin(*TIERS) & J.is_type(J.at(s, "$.content"), "STRING") & _count(s, "$.tokenCount")),
         "tierSegments: fields, tier, content or tokenCount"),
        ("E13", F.forall(segments, lambda s: _absent_or(s, "$.sourceIds", _strings(J.elements(s, "$.sourceIds")))),
         "tierSegments: sourceIds"),
        ("E14", F.forall(segments, attributed), "a segment maps to no message or tool of the request"),
    ])


def response_violations(rows, key, response="response"):
    """Violations of E15 over VARIANT responses."""
    r = F.col(response)
    return flag(rows, key, F.lit("response"), [
        ("E15", J.only_keys(r, RESPONSE_FIELDS) & J.at(r, "$.content").isNotNull()
         & _content_ok(J.at(r, "$.content"), F.lit(True)), "response: fields or content"),
        ("E15", _absent_or(r, "$.toolCalls", _calls_ok(J.elements(r, "$.toolCalls"))), "response.toolCalls"),
        ("E15", _named(r, "$.finishReason"), "response.finishReason: required"),
        ("E15", J.only_keys(J.at(r, "$.usage"), ("promptTokens", "completionTokens")) & _count(r, "$.usage.promptTokens")
         & _count(r, "$.usage.completionTokens"), "response.usage: nonnegative integers"),
        ("E15", _absent_or(r, "$.modelVersion", _named(r, "$.modelVersion")), "response.modelVersion"),
    ])


def attribution_violations(rows, key, request="request", prefix="stablePrefix"):
    """E17: every message and tool is attributed once, and the stable prefix is the real beginning.

    rows: key, VARIANT request and the run's stable prefix as array<string>.
    """
    r, p = F.col(request), F.col(prefix)
    rows = unpack(rows, request)
    messages, segments = F.col("_messages"), F.col("_segments")
    none = F.array().cast("array<variant>")

    def gathered(name, kind):
        lists = F.transform(segments, lambda s: F.coalesce(J.elements(s, f"$.{name}"), none))
        return F.array_sort(F.transform(F.flatten(lists), lambda v: v.try_cast(kind)))
    stable = F.filter(segments, lambda s: _text(s, "$.tier") == "stable")
    leading = F.slice(segments, 1, F.size(stable))
    numbered = F.transform(stable, lambda s, i: F.struct(s.alias("s"), i.alias("i")))

    def real(x):
        at = F.get(messages, x["i"])
        return ((J.at(x["s"], "$.messageIndices", "array<int>") == F.array(x["i"]))
                & (F.coalesce(F.size(J.elements(x["s"], "$.toolNames")), F.lit(0)) == 0)
                & (at["role"] == "system") & (at["content"].try_cast("string") == F.get(p, x["i"])))
    return flag(rows, key, F.coalesce(_text(r, "$.requestId"), F.lit("request")), [
        ("E17", F.when(F.size(messages) > 0, gathered("messageIndices", "bigint")
                       == F.transform(messages, lambda m: m["i"].cast("bigint"))), "segments cover each message once"),
        ("E17", gathered("toolNames", "string") == F.array_sort("_tools"), "segments cover each tool once"),
        ("E17", (F.transform(stable, lambda s: _text(s, "$.content")) == p)
         & F.forall(leading, lambda s: _text(s, "$.tier") == "stable"), "stable segments are not the run's prefix"),
        ("E17", F.forall(numbered, real), "the first system messages are not the prefix"),
    ])


def pinning_violations(rows, key, request="request", model="model"):
    """E18: model, decoding settings and seed are those pinned by the run.  model: VARIANT."""
    r, m = F.col(request), F.col(model)
    return flag(rows, key, F.coalesce(_text(r, "$.requestId"), F.lit("request")), [
        ("E18", _same(J.at(r, "$.model"), m) & _same(J.at(r, "$.decodingSettings"), J.at(m, "$.decoding"))
         & F.to_json(J.at(r, "$.seed")).eqNullSafe(F.to_json(J.at(m, "$.seed"))),
         "model, decoding or seed differ from the run's")])


def input_violations(rows, key, kind, value="value"):
    """P11: only agent-visible fields cross to the agent; required strings are present."""
    v = F.col(value)
    required = ("turnId", "text") if kind == "turn" else ("probeId", "question")
    rules = [("P11", J.only_keys(v, INPUT_FIELDS[kind]), f"{kind}: unexpected fields; strip scorer data")]
    rules += [("P11", _named(v, f"$.{name}"), f"{kind}.{name}: expected nonempty string") for name in required]
    if kind == "turn":
        rules += [("P11", _text(v, "$.role") == "user", "turn.role: required user"),
                  ("P11", _absent_or(v, "$.sessionId", _named(v, "$.sessionId")), "turn.sessionId: expected nonempty string")]
    return flag(rows, key, F.lit(kind), rules)
