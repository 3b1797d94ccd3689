"""Personal data against the base patterns as Python's engine reads them."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from mnemoscope.llm import pii
from mnemoscope.llm.queries import op1
from tests.llm import cases

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text):
    spans = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                spans.append((kind, m.start(), m.end()))
    return spans


def texts():
    rng = random.Random(8)
    parts = ["a@b.co", "x.y+z@mail-1.example.com", "@", ".", "+1 (864) 555-0138", "+", "4111 1111 1111 1111", "4111-1111-1111-1111", "é", "😀",
             "1.2.3.4", "255.255.255.255", "256.1.1.1", "001.002.003.0004", "1.2.3", "12", " ", "-", "(", ")", "_", "%", "b.c", "\n", "word",
             "5500005555555559", "378282246310005", "@x.y@z.w", "+49 30 123456", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(600)] + [
        "7" * 5000, "a" * 5000 + "@", "a.b@" * 2000, "1." * 3000, "a@b" + ".c" * 9000, "+1" + " " * 5000, "4 " * 5000]


def test_base_spans_equal_the_patterns(spark):
    docs = cases.awkward(spark, texts())
    found = pii.find(docs).select("doc_id", "text", "base_spans", "pii_spans").collect()
    assert len(found) == docs.count()
    for row in found:
        want = expected(row.text or "")
        assert [(s.kind, s.start, s.end) for s in row.base_spans] == want, repr(row.text)[:200]
        assert row.pii_spans[:len(want)] == row.base_spans
        assert all(0 <= s.score <= 1 for s in row.pii_spans)
    assert pii.find(cases.empty(spark)).count() == 0


def test_accounts_context_and_redaction(spark):
    docs = spark.createDataFrame([(1, "pay to iban GB82 WEST 1234 5698 7654 32 now"), (2, "GB82 WEST 1234 5698 7654 33"),
                                  (3, "server at ip 10.0.0.1"), (4, "version 10.0.0.1"), (5, "mail a@b.co, 10.0.0.1")], "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert [s.kind for s in rows[1].pii_spans] == ["iban"] and not rows[2].pii_spans
    assert rows[3].pii_spans[0].score > rows[4].pii_spans[0].score
    assert rows[1].redacted == "pay to iban [iban] now" and rows[4].redacted == "version 10.0.0.1"
    assert rows[5].redacted == "mail [email], [ip]"


def test_accounts_before_capitals_and_digits(spark):
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    cases_of = [(f"IBAN {de} BIC COBADEFFXXX", [de]), ("GB82WEST12345698765432 OR 5 MORE", ["GB82WEST12345698765432"]), (f"{de} A", [de]),
                (f"{gb} BIC NWBKGB2L", [gb]), (f"{de} {gb} X", [de, gb]), (f"😀 AB12 {de}", [de]), (f"{de}X", []), (f"X{de} 1", []),
                (f"{de[:-1]}1 BIC COBADEFFXXX", []), ("MT84MALT011000012345MTLCAST001S 7", ["MT84MALT011000012345MTLCAST001S"])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases_of)], "doc_id int, text string")
    for row in pii.redact(docs).collect():
        want = cases_of[row.doc_id][1]
        assert [row.text[s.start:s.end] for s in row.pii_spans if s.kind == "iban"] == want, row.text
        assert row.redacted.count("[iban]") == len(want) and not any(w in row.redacted for w in want)


def test_query_counts_and_hash(spark):
    if not cases.has_tables():
        return
    texts_of = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{cases.FOLDER}/documents.parquet").collect()}
    got = op1(spark, cases.FOLDER)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for row in got.collect():
        want = expected(texts_of[row.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert row.spans.startswith(listed)


def test_luhn_and_mod97(spark):
    row = spark.range(1).select(pii.luhn(F.lit("4111111111111111")), pii.luhn(F.lit("4111111111111112")),
                                pii.mod97(F.lit("DE89370400440532013000")), pii.mod97(F.lit("DE89370400440532013001"))).first()
    assert tuple(row) == (True, False, True, False)
