"""Token counts by pinned tokenizer name, and the wire form they are counted over."""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_BUDGET = 25_000

# Fixed value: provider fields that decoding settings must not override.
WIRE_RESERVED = ("model", "messages", "tools", "tool_calls", "seed", "stream")


def _tiktoken_counter(encoding):
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken
        encoder = tiktoken.get_encoding(encoding)
        return texts.map(lambda text: len(encoder.encode(text, disallowed_special=())),
                         na_action="ignore")
    return count


_COUNTERS = {"characters-smoke": lambda text: F.char_length(text).cast("bigint")}


def register_tokenizer(name, counter):
    """Add a counter: a function from a text column to a bigint column."""
    _COUNTERS[name] = counter


def count_tokens(text, tokenizer="characters-smoke"):
    """Tokens of a text column under a named tokenizer (``tiktoken:<encoding>`` or registered)."""
    if tokenizer.startswith("tiktoken:"):
        return _tiktoken_counter(tokenizer.split(":", 1)[1])(text)
    if tokenizer not in _COUNTERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    return _COUNTERS[tokenizer](text)


def over_budget(total, budget=TOKEN_BUDGET):
    """The budget is inclusive: only a total above it fails."""
    return total > budget


def _dump(value):
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _wire_message(message):
    wire = {"role": message["role"], "content": message["content"]}
    if "toolCalls" in message:
        wire["tool_calls"] = [
            {"id": call["id"], "type": "function",
             "function": {"name": call["name"], "arguments": _dump(call["arguments"])}}
            for call in message["toolCalls"]]
    if "toolCallId" in message:
        wire["tool_call_id"] = message["toolCallId"]
    return wire


_WIRE = T.StructType([
    T.StructField("body", T.StringType()), T.StructField("messages", T.ArrayType(T.StringType())),
    T.StructField("tools", T.ArrayType(T.StringType())), T.StructField("toolNames", T.ArrayType(T.StringType()))])


def _wire_row(text):
    """Body, messages, tools and tool names of one request; NULLs for one that lacks its parts."""
    try:
        request = json.loads(text)
        settings = request["decodingSettings"]
        if set(WIRE_RESERVED) & set(settings):
            return None, None, None, None
        messages = [_wire_message(message) for message in request["messages"]]
        tools = [{"type": "function", "function": tool} for tool in request.get("tools", [])]
        body = {"model": request["model"]["version"], "messages": messages, **settings}
        body |= {"seed": request["seed"]} if "seed" in request else {}
        body |= {"tools": tools} if "tools" in request else {}
        return (_dump(body), [_dump(m) for m in messages], [_dump(t) for t in tools],
                [tool["function"]["name"] for tool in tools])
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None, None, None, None


@F.pandas_udf(_WIRE)
def wire_parts(requests: pd.Series) -> pd.DataFrame:
    """Provider body of a native request and the JSON of each message and tool, byte for byte.

    Token counts depend on the order in which keys were written, which neither VARIANT nor a typed
    struct keeps, so this one conversion runs in Arrow batches.
    """
    rows = [_wire_row(text) for text in requests]
    return pd.DataFrame(rows, columns=["body", "messages", "tools", "toolNames"])


def response_text(content):
    """Conversational text of a response's content: a string, its text parts joined, or ''."""
    kind = F.schema_of_variant(content)
    parts = F.try_variant_get(content, "$", "array<struct<type string, text string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"),
                                      lambda p: p["text"]), "")
    return (F.when(kind == "STRING", F.try_variant_get(content, "$", "string"))
            .when(kind.startswith("ARRAY"), F.coalesce(joined, F.lit("")))
            .otherwise(F.lit("")))
