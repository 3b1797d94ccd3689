"""JSON-lines run logs: strict typed reading, reject tables, and redacted appending."""

from pyspark.sql import functions as F

from mnemoscope import schemas
from mnemoscope.functions import jsontype as J
from mnemoscope.functions.redact import redact_json


def _typed(lines, ddl):
    """Lines with their typed row; ok is false for anything but one strict JSON object."""
    ok = J.is_type(J.strict(F.col("value")), "OBJECT")
    return lines.select("value", ok.alias("ok"), F.from_json("value", schemas.struct(ddl)).alias("row"))


def parse_lines(lines, ddl):
    """(rows, rejects) of a table of JSON text lines, batch or streaming."""
    typed = _typed(lines.filter("trim(value) <> ''"), ddl)
    return typed.filter("ok").select("row.*"), typed.filter("NOT ok").select("value")


def read_jsonl(spark, path, ddl):
    """(rows, rejects) of JSON-lines files."""
    return parse_lines(spark.read.text(path), ddl)


def stream_jsonl(spark, path, ddl, files_per_trigger=1000):
    """The same over a growing folder, as streams."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), ddl)


def redacted_lines(rows, secrets=()):
    """Rows as JSON text lines with credentials masked at any depth."""
    return rows.select(redact_json(F.to_json(F.struct(*rows.columns)), secrets).alias("value"))


def append_jsonl(rows, path, secrets=()):
    """Append rows to a folder of JSON-lines files, redacted."""
    redacted_lines(rows, secrets).write.mode("append").text(path)
