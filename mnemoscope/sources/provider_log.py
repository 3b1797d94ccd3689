"""Provider chat-completion responses as native response rows, with a reject table."""

from pyspark.sql import functions as F

from mnemoscope.functions import jsontype as J
from mnemoscope.functions.ratio import holds
from mnemoscope.quality.envelope_rules import response_violations


def native_responses(rows, key, body="body"):
    """(rows, rejects): content, finishReason, usage, toolCalls with decoded arguments, modelVersion.

    Rejected are bodies that are no strict JSON, lack a choice, hold a call that is no function or
    whose arguments are no JSON text, or violate the native response rules.
    """
    v = F.col("_v")
    choice, usage = J.at(v, "$.choices[0]"), J.at(v, "$.usage")
    message = J.at(v, "$.choices[0].message")
    calls = J.elements(message, "$.tool_calls")
    has_calls = J.at(message, "$.tool_calls").isNotNull()
    decoded = F.transform(calls, lambda c: F.struct(
        J.at(c, "$.id", "string").alias("id"), J.at(c, "$.function.name", "string").alias("name"),
        J.strict(J.at(c, "$.function.arguments", "string")).alias("arguments")))
    calls_ok = F.forall(calls, lambda c: (J.at(c, "$.type", "string") == "function")
                        & J.is_type(J.at(c, "$.function.arguments"), "STRING"))
    parts = [
        F.struct(F.lit("content").alias("key"), F.to_json(J.at(message, "$.content")).alias("value")),
        F.struct(F.lit("finishReason").alias("key"), F.to_json(J.at(choice, "$.finish_reason")).alias("value")),
        F.struct(F.lit("usage").alias("key"), F.concat(
            F.lit('{"promptTokens":'), F.coalesce(F.to_json(J.at(usage, "$.prompt_tokens")), F.lit("null")),
            F.lit(',"completionTokens":'), F.coalesce(F.to_json(J.at(usage, "$.completion_tokens")), F.lit("null")),
            F.lit("}")).alias("value")),
        F.struct(F.lit("toolCalls").alias("key"), F.when(has_calls, F.to_json(decoded)).alias("value")),
        F.struct(F.lit("modelVersion").alias("key"), F.to_json(J.at(v, "$.model")).alias("value"))]
    present = F.filter(F.array(*parts), lambda p: p["value"].isNotNull())
    text = F.concat(F.lit("{"), F.array_join(F.transform(
        present, lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), p["value"])), ","), F.lit("}"))
    mapped = (rows.withColumn("_v", J.strict(F.col(body)))
              .withColumn("_mapped", F.when(choice.isNotNull() & (~has_calls | holds(calls_ok)), text))
              .withColumn("response", J.strict(F.col("_mapped"))))
    problems = (response_violations(mapped.select(key, "response"), key)
                .select(F.col("scope").alias(key), "detail").distinct()
                .groupBy(key).agg(F.min("detail").alias("problem")))
    judged = mapped.join(problems, key, "left")
    bad = F.col("response").isNull() | F.col("problem").isNotNull()
    good = judged.filter(~bad).select(
        key, J.at(F.col("response"), "$.content").alias("content"), J.at(F.col("response"), "$.finishReason", "string").alias("finishReason"),
        J.at(F.col("response"), "$.usage.promptTokens", "bigint").alias("promptTokens"),
        J.at(F.col("response"), "$.usage.completionTokens", "bigint").alias("completionTokens"),
        J.at(F.col("response"), "$.toolCalls").alias("toolCalls"),
        J.at(F.col("response"), "$.modelVersion", "string").alias("modelVersion"))
    rejects = judged.filter(bad).select(key, F.col(body).alias("body"), F.coalesce("problem", F.lit("invalid provider response")).alias("problem"))
    return good, rejects
