"""Answer matching, scalar functions and redaction over whole tables."""

from pyspark.sql import functions as F

from mnemoscope.functions import canonical, redact, text, tokens
from mnemoscope.functions.number import within
from mnemoscope.operators import matching as X
from mnemoscope.plans.catalog import query
from mnemoscope.sources.tables import dealt, table

_DECLINES = ", ".join("'" + phrase.replace("'", "''") + "'" for phrase in text.DECLINES)


def _expected(match_type, accepted, target=None, tolerance=None):
    none = F.lit(None).cast("string")
    return F.struct(match_type.alias("matchType"), accepted.alias("acceptedAnswers"),
                    (none if target is None else target).alias("targetNumber"),
                    (none if tolerance is None else tolerance).alias("tolerance"), none.alias("toleranceMode"))


def customer_answers(spark, folder):
    """Every customer answers with a market segment: spelled as accepted, padded, declined or wrong."""
    segment = F.col("c_mktsegment")
    answer = (F.when(F.col("c_acctbal") < -500, " I do NOT know. ").when(F.col("c_acctbal") < 0, F.lit(None))
              .when(F.col("c_nationkey") < 8, F.concat(F.lit("  "), F.lower(segment), F.lit("\t")))
              .when(F.col("c_nationkey") < 16, F.initcap(segment))
              .when(F.col("c_nationkey") < 20, F.lit("Unknown!?")).otherwise(F.concat(F.lit("the "), segment)))
    unanswerable = F.col("c_nationkey").between(14, 17)
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("probeId"), answer.alias("answer"), (~unanswerable).alias("answerability"),
        F.when(unanswerable, _expected(F.lit("abstain"), F.array(F.lit("I do not know."), F.lit("unknown!?"))))
        .otherwise(_expected(F.lit("exact"), F.array(segment, F.lit("none")))).alias("expected"))


_CUSTOMER = """ans AS (SELECT c_custkey AS "probeId", c_mktsegment, c_nationkey BETWEEN 14 AND 17 AS un,
 CASE WHEN c_acctbal < -500 THEN ' I do NOT know. ' WHEN c_acctbal < 0 THEN NULL
 WHEN c_nationkey < 8 THEN '  ' || lower(c_mktsegment) || chr(9)
 WHEN c_nationkey < 16 THEN substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2))
 WHEN c_nationkey < 20 THEN 'Unknown!?' ELSE 'the ' || c_mktsegment END AS answer FROM customer),
 n AS (SELECT *, trim(regexp_replace(lower(coalesce(answer, '')), '\\s+', ' ', 'g')) AS norm FROM ans),
 m AS (SELECT *, answer IS NOT NULL AND CASE WHEN un THEN norm IN ('i do not know.', 'unknown!?') ELSE norm IN (lower(c_mktsegment), 'none') END AS hit FROM n)
"""


@query("f05_match_exact_abstain", f"""WITH {_CUSTOMER}
 SELECT "probeId", CASE WHEN un THEN CASE WHEN hit THEN 'abstain' ELSE 'fail' END WHEN hit THEN 'pass'
 WHEN answer IS NOT NULL AND regexp_replace(norm, '[.!?]+$', '') IN ({_DECLINES}) THEN 'abstain' ELSE 'fail' END AS judgment,
 hit AS correct, norm AS "normalizedAnswer", CASE WHEN un THEN 'abstain' ELSE 'exact' END AS "matchingMethod" FROM m""")
def f05(spark, folder):
    return X.match_answers(customer_answers(spark, folder)).select(
        "probeId", "judgment", "correct", "normalizedAnswer", "matchingMethod")


def line_answers(spark, folder):
    """Line items answer a number (returned lines) or a list of their flags (the others)."""
    numeric = F.col("l_returnflag") == "R"
    flags = F.to_json(F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    said = (F.when(F.col("l_linenumber") < 3, F.lower(flags))
            .when(F.col("l_linenumber") < 5, F.to_json(F.array("l_linestatus", "l_returnflag", F.col("l_linenumber").cast("string"))))
            .when(F.col("l_linenumber") < 6, F.concat_ws(", ", "l_returnflag", "l_linestatus")).otherwise(
                F.concat(F.lit('[" '), F.col("l_returnflag"), F.lit(' ", "'), F.col("l_linestatus"), F.lit('", '),
                         F.col("l_linenumber"), F.lit("]"))))
    return dealt(table(spark, folder, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.lit(True).alias("answerability"),
        F.when(numeric, F.col("l_tax").cast("decimal(10,2)").cast("string")).otherwise(said).alias("answer"),
        F.when(numeric, _expected(F.lit("numeric"), F.array(F.lit("7")), F.col("l_discount").cast("decimal(10,2)").cast("string"), F.lit("0.03")))
        .otherwise(_expected(F.lit("ordered-list"), F.array(F.lit('["x"]'), flags))).alias("expected"))


@query("f10_match_dispatch", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 CASE WHEN CASE WHEN l_returnflag = 'R' THEN abs(CAST(l_tax AS DECIMAL(10,2)) - CAST(l_discount AS DECIMAL(10,2))) <= 0.03
  WHEN l_linenumber < 3 THEN TRUE WHEN l_linenumber < 6 THEN FALSE ELSE TRUE END THEN 'pass' ELSE 'fail' END AS judgment,
 CASE WHEN l_returnflag = 'R' THEN 'numeric' ELSE 'ordered-list' END AS "matchingMethod" FROM lineitem""")
def f10(spark, folder):
    return X.match_answers(line_answers(spark, folder)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "judgment", "matchingMethod")


@query("f03_within_tolerance", """SELECT l_returnflag, l_linenumber, count(*) AS n, count(*) FILTER (
 abs(CAST(l_tax AS DECIMAL(10,2)) - CAST(l_discount AS DECIMAL(10,2))) <= 0.03) AS within_tolerance FROM lineitem GROUP BY 1, 2""")
def f03(spark, folder):
    near = within(F.col("l_tax").cast("decimal(10,2)").cast("string"),
                  F.col("l_discount").cast("decimal(10,2)").cast("string"), F.lit("0.03"))
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(near).alias("within_tolerance"))


@query("f01_normalize", """SELECT doc_id, length(t) AS n_normalized, sha256(t) AS digest FROM (
 SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS t FROM documents)""")
def f01(spark, folder):
    return (table(spark, folder, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))
            .select("doc_id", F.char_length("t").cast("bigint").alias("n_normalized"), F.sha2("t", 256).alias("digest")))


_REDACT_SQL = """regexp_replace(regexp_replace(regexp_replace({0},
 '(?i)(\\b(?:proxy[-_ ]?)?authorization["'']?\\s*[:=]\\s*)(?:"[^"\\r\\n]*"|''[^''\\r\\n]*''|[^\\r\\n,;]+)', '\\1[REDACTED]', 'g'),
 '(?i)(\\b(?:x[-_ ]?)?api[-_ ]?key["'']?\\s*[:=]\\s*)(?:"[^"\\r\\n]*"|''[^''\\r\\n]*''|[^\\s,;"'']+)', '\\1[REDACTED]', 'g'),
 '(?i)\\bBearer\\s+[^\\s,;"'']+', 'Bearer [REDACTED]', 'g')"""


@query("f15_redact", f"""SELECT doc_id, sha256(r) AS digest, r <> t AS masked FROM (SELECT doc_id, t, {_REDACT_SQL.format('t')} AS r FROM (
 SELECT doc_id, 'Authorization: Basic ' || source || '; ' || replace(text, 'token =', 'api_key =') || ' bearer ' || lang AS t FROM documents))""")
def f15(spark, folder):
    logged = F.concat(F.lit("Authorization: Basic "), F.col("source"), F.lit("; "),
                      F.replace("text", F.lit("token ="), F.lit("api_key =")), F.lit(" bearer "), F.col("lang"))
    rows = table(spark, folder, "documents").select("doc_id", logged.alias("t"))
    return rows.select("doc_id", F.sha2(redact.redact_text(F.col("t")), 256).alias("digest"),
                       redact.has_credentials(F.col("t")).alias("masked"))


@query("f16_credential_check", f"""SELECT source, count(*) AS n, count(*) FILTER ({_REDACT_SQL.format("replace(text, 'token =', 'api_key =')")} <> replace(text, 'token =', 'api_key =')) AS with_credentials FROM documents GROUP BY source""")
def f16(spark, folder):
    body = F.replace("text", F.lit("token ="), F.lit("api_key ="))
    return table(spark, folder, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(redact.has_credentials(body)).alias("with_credentials"))


@query("f22_count_tokens", """SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS tokens, max(length(text)) > 1000 AS over_budget FROM conversations GROUP BY conv_id""")
def f22(spark, folder):
    counted = table(spark, folder, "conversations").select("conv_id", tokens.count_tokens(F.col("text")).alias("n"))
    return counted.groupBy("conv_id").agg(F.sum("n").alias("tokens"),
                                          tokens.over_budget(F.max("n"), 1000).alias("over_budget"))


@query("s06_digest", """SELECT event_id, sha256('{"event":"' || event_type || '","id":' || event_id || ',"user":' || user_id || '}' || chr(10)) AS digest,
 substr(sha256('run-' || user_id), 1, 16) || '-' || event_type AS directory FROM events""")
def s06(spark, folder):
    document = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.col("event_type").alias("event")))
    return table(spark, folder, "events").select(
        "event_id", canonical.digest(document).alias("digest"),
        canonical.run_directory(F.concat(F.lit("run-"), F.col("user_id")), F.col("event_type")).alias("directory"))
