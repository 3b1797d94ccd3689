import json
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemoscope.functions.secret_forms import Masker, folded, mask_forms, mask_judge_output, merged

LETTERS = st.text(st.sampled_from("ab AB\t\nßｂﬁȩ́́각각İ½"), max_size=12)


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_folding_equals_that_of_the_whole_text(text):
    simple, spans = folded(text)
    assert simple == " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    assert len(spans) == len(simple) and spans == sorted(spans)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=3), LETTERS)
def test_spans_equal_a_search_at_every_place(secrets, text):
    found = [(i, i + len(s)) for s in secrets if s for i in range(len(text)) if text.startswith(s, i)]
    simple, places = folded(text)
    for plain in {folded(s)[0] for s in secrets} - {""}:
        found += [(places[i][0], places[i + len(plain) - 1][1]) for i in range(len(simple)) if simple.startswith(plain, i)]
    assert Masker(secrets).spans(text) == merged(found)


def test_no_part_of_an_overlapping_secret_stays():
    masker = Masker(["my key", "keyboard", "board"])
    assert masker("a MY  keyBoard, board, keyb") == "a [REDACTED], [REDACTED], keyb"
    assert Masker(["six"])("sixsix") == "[REDACTED][REDACTED]" and Masker(["aa"])("aaaa b") == "[REDACTED] b"
    assert Masker(["fine"])("reﬁned") == "re[REDACTED]d"  # the ligature goes as a whole
    assert Masker(["e"])("café é") == "café [REDACTED]́"
    assert Masker([])("x") == "x" and Masker(["  "])("a  b") == "a[REDACTED]b" and Masker(["x"])("") == ""


def test_columns_of_texts_and_of_judge_output(spark):
    secrets = ("Judge-Secret\\E|x", "order key", "")
    texts = ["ORDER  Key", "no key", None, "", "judge-secret\\e|X.", "Bearer abc def", "x" * 300_000 + "order key"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in rows.select("i", mask_forms(F.col("t"), secrets).alias("x")).orderBy("i").collect()]
    assert got == ["[REDACTED]", "no key", None, "", "[REDACTED].", "Bearer [REDACTED] def", "x" * 300_000 + "[REDACTED]"]
    outputs = [json.dumps({"Order Key": [{"text": "ｏrder\nKEY!", "apiKey": "z"}], "n": 1.5}), "no json: oRder key", None, "{}", "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(outputs)], "i int, t string")
    got = [r.x for r in rows.select("i", mask_judge_output(F.col("t"), secrets).alias("x")).orderBy("i").collect()]
    assert json.loads(got[0]) == {"[REDACTED]": [{"text": "[REDACTED]!", "apiKey": "[REDACTED]"}], "n": 1.5}
    assert got[1:] == ["no json: [REDACTED]", None, "{}", "[]"]
    assert rows.limit(0).select(mask_judge_output(F.col("t"), secrets)).collect() == []


def test_text_without_secrets_needs_no_python(spark):
    rows = spark.createDataFrame([("plain",)], "t string")
    assert rows.select(mask_forms(F.col("t"), ()).alias("x")).first().x == "plain"
