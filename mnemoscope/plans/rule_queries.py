"""Data-quality rules and per-record functions over whole tables."""

from pyspark.sql import functions as F

from mnemoscope.functions import canonical, text
from mnemoscope.functions import jsontype as J
from mnemoscope.functions.number import is_number
from mnemoscope.functions.redact import redact_json
from mnemoscope.functions.tokens import response_text, wire_parts
from mnemoscope.operators import archive as A
from mnemoscope.operators import fixtures as X
from mnemoscope.operators import matching as H
from mnemoscope.operators import metrics as M
from mnemoscope.operators.scans import range_blocks, running
from mnemoscope.plans.catalog import query
from mnemoscope.plans.metric_queries import VIEWS
from mnemoscope.quality import archive_rules as R
from mnemoscope.quality import envelope_rules as E
from mnemoscope.quality.manifest_rules import missing_fields, run_manifest_violations
from mnemoscope.session import scratch_folder
from mnemoscope.sources import provider_log, publish
from mnemoscope.sources import tables as T


def per_rule(violations):
    return violations.groupBy("ruleId").agg(F.count(F.lit(1)).alias("violations"))


@query("s03_strict_json", """SELECT event_type, count(*) AS rows, count(*) FILTER (event_type NOT IN ('click', 'signup', 'error')) AS strict FROM events GROUP BY 1""")
def s03(spark, folder):
    body = (F.when(F.col("event_type") == "click", F.lit('{"k":1,"k":2}')).when(F.col("event_type") == "signup", F.lit('{"k":NaN}'))
            .when(F.col("event_type") == "error", F.lit('{"k":')).otherwise(F.col("props")))
    return T.table(spark, folder, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(J.is_type(J.strict(body), "OBJECT")).alias("strict"))


@query("s07_publish_identities", """SELECT sha256(o_orderpriority || '|' || o_orderstatus) AS identity, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def s07(spark, folder):
    rows = T.table(spark, folder, "orders").select(
        F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), 256).alias("identity"), "o_orderkey")
    target = scratch_folder(spark, "published")
    publish.publish(rows.filter(F.col("identity") < "8"), target)
    # Publishing everything adds the identities that are new and leaves the others as they are.
    publish.publish(rows, target)
    return spark.read.parquet(target).groupBy("identity").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


_DOC_RESPONSE = """CASE WHEN source = 'src3' THEN 'finish' WHEN source = 'src4' THEN 'usage' END"""


def provider_bodies(spark, folder):
    """Every document as a chat-completion body; some sources lack a finish reason or count below 0."""
    message = F.struct(F.col("text").alias("content"))
    choice = F.struct(message.alias("message"), F.when(F.col("source") != "src3", "stop").alias("finish_reason"))
    usage = F.struct(F.when(F.col("source") == "src4", -1).otherwise(F.col("n_chars")).alias("prompt_tokens"), F.lit(7).alias("completion_tokens"))
    return T.table(spark, folder, "documents").select("doc_id", F.to_json(F.struct(
        F.array(choice).alias("choices"), usage.alias("usage"), F.col("lang").alias("model"))).alias("body"))


@query("s14_provider_responses", """SELECT doc_id, sha256(text) AS content, 'stop' AS "finishReason", n_chars AS "promptTokens", 7 AS "completionTokens", lang AS "modelVersion" FROM documents WHERE source NOT IN ('src3', 'src4')""")
def s14(spark, folder):
    good, _ = provider_log.native_responses(provider_bodies(spark, folder), "doc_id")
    return good.select("doc_id", F.sha2(J.at(F.col("content"), "$", "string"), 256).alias("content"), "finishReason",
                       "promptTokens", "completionTokens", "modelVersion")


@query("s14_provider_rejects", """SELECT doc_id, CASE source WHEN 'src3' THEN 'response.finishReason: required' ELSE 'response.usage: nonnegative integers' END AS problem FROM documents WHERE source IN ('src3', 'src4')""")
def s14_rejects(spark, folder):
    _, rejects = provider_log.native_responses(provider_bodies(spark, folder), "doc_id")
    return rejects.select("doc_id", "problem")


@query("f24_response_text", """SELECT doc_id, sha256(CASE lang WHEN 'en' THEN text WHEN 'fr' THEN text || source ELSE '' END) AS digest FROM documents""")
def f24(spark, folder):
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
                              F.struct(F.lit("image").alias("type"), F.lit("skip").alias("text")),
                              F.struct(F.lit("text").alias("type"), F.col("source").alias("text"))))
    content = (F.when(F.col("lang") == "en", F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2))
               .when(F.col("lang") == "fr", parts).otherwise(F.lit("null")))
    return T.table(spark, folder, "documents").select(
        "doc_id", F.sha2(response_text(F.parse_json(content)), 256).alias("digest"))


def _payload():
    k = F.col("k")
    return (F.when(k < 20, F.lit('{"turns":[{"text":"Expected","Expected_\\u0041nswer":1}]}'))
            .when(k < 40, F.lit('{"a":{"b":[1,{"introducedFactIds":[]},{"match-type":"x"}]}}'))
            .when(k < 60, F.lit('{"note":"\\"facts\\": in a value","ok":true}')).otherwise(F.concat(F.lit('{"k":'), k, F.lit("}"))))


@query("p02_gold_leaks", VIEWS + """SELECT seq, CASE WHEN k < 20 THEN ['expectedanswer'] ELSE ['introducedfactids', 'matchtype'] END AS names FROM request WHERE k < 40""")
def p02(spark, folder):
    rows = T.requests(spark, folder).withColumn("payload", _payload())
    return X.leaking_rows(rows, "seq", "payload")


@query("p02_gold_leak_paths", VIEWS + """SELECT seq, unnest(CASE WHEN k < 20 THEN ['$.turns[0].Expected_Answer'] ELSE ['$.a.b[1].introducedFactIds', '$.a.b[2].match-type'] END) AS path FROM request WHERE k < 40""")
def p02_paths(spark, folder):
    rows = T.requests(spark, folder).withColumn("payload", _payload())
    return X.gold_leaks(rows, "seq", "payload")


@query("p02_leaks_among_quotes", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['facts'] ELSE ['evidenceids', 'expected'] END AS names FROM documents WHERE doc_id % 3 < 2""")
def p02_quotes(spark, folder):
    """Every whole text as a value, once with quotes around each word, and keys that begin with a colon or hide in escapes."""
    text = F.coalesce("text", F.lit(""))
    quoted = F.concat(F.lit('"facts": '), F.regexp_replace(text, r"\\w+", '"$0":'))
    values = [text.alias("text"), quoted.alias("quoted"), F.array(quoted, F.lit(':"')).alias("list")]
    case = F.pmod("doc_id", F.lit(3))
    # An escape that stands for a letter cannot come out of a JSON writer, so it is put in afterwards.
    hidden = F.replace(F.to_json(F.struct(*values, F.struct(F.lit(1).alias("evidence ids")).alias('say "Expected"'))), F.lit("evidence ids"), F.lit("\\u0065vidence_ids"))
    payload = (F.when(case == 0, F.to_json(F.struct(*values, F.array().alias(":facts")))).when(case == 1, F.replace(hidden, F.lit("say "), F.lit("")))
               .otherwise(F.to_json(F.struct(*values))))
    return X.leaking_rows(T.table(spark, folder, "documents").select("doc_id", payload.alias("payload")), "doc_id", "payload")


@query("p03_projection_differences", """SELECT c_custkey, unnest(['missing or changed', 'not in the projection']) AS problem FROM customer WHERE c_acctbal < 0""")
def p03(spark, folder):
    view = T.table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    given = T.table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "other").otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment")
    return X.projection_differences(view, given, ["c_custkey"])


@query("p03_typed_differences", """WITH c AS (SELECT *, c_custkey % 7 AS k FROM customer)
 SELECT c_custkey, '$.name' AS path, 'type' AS problem, 'integer' AS found, 'string' AS wanted FROM c WHERE k = 1
 UNION ALL SELECT c_custkey, '$.lines', 'length', '2', '3' FROM c WHERE k = 2
 UNION ALL SELECT c_custkey, '$.lines[1].segment', 'value', '"other"', '"' || c_mktsegment || '"' FROM c WHERE k = 2
 UNION ALL SELECT c_custkey, '$.home.extra', 'extra', 'null', NULL FROM c WHERE k = 3
 UNION ALL SELECT c_custkey, '$.home.nation', 'missing', NULL, 'integer' FROM c WHERE k = 4
 UNION ALL SELECT c_custkey, '$.lines[2].one', 'type', 'number', 'integer' FROM c WHERE k = 5
 UNION ALL SELECT c_custkey, '$.lines[0]', 'type', 'null', 'boolean' FROM c WHERE k = 5""")
def p03_typed(spark, folder):
    """Documents of nested members, arrays and numbers, changed in type, value, length and members; their order says nothing."""
    k = F.pmod("c_custkey", F.lit(7))

    def document(name, first, second, third, nation, extra):
        home = F.concat_ws(",", nation, extra, F.concat(F.lit('"balance":'), F.col("c_acctbal").cast("string")))
        return F.parse_json(F.concat(F.lit('{"lines":['), F.concat_ws(",", first, second, third), F.lit('],"home":{'), home, F.lit('},"name":'), name, F.lit("}")))

    def line(text):
        return F.concat(F.lit('{"segment":"'), text, F.lit('"}'))

    name, nation = F.concat(F.lit('"'), "c_name", F.lit('"')), F.concat(F.lit('"nation":'), "c_nationkey")
    one, nothing = F.lit('{"one":1}'), F.lit(None).cast("string")
    wanted = document(name, F.lit("true"), line(F.col("c_mktsegment")), one, nation, nothing)
    given = document(F.when(k == 1, F.col("c_custkey").cast("string")).otherwise(name), F.when(k == 5, "null").otherwise(F.lit("true")),
                     line(F.when(k == 2, "other").otherwise(F.col("c_mktsegment"))), F.when(k == 2, nothing).when(k == 5, '{"one":1.0}').otherwise(one),
                     F.when(k != 4, nation), F.when(k == 3, F.lit('"extra":null')))
    rows = T.dealt(T.table(spark, folder, "customer")).select("c_custkey", given.alias("given"), wanted.alias("wanted_document"))
    return X.typed_differences(rows, ["c_custkey"], "given", "wanted_document")


@query("p11_agent_inputs", """SELECT role, count(*) AS violations FROM conversations WHERE role <> 'user' GROUP BY 1""")
def p11(spark, folder):
    body = F.parse_json(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("turnId"), "role", "text")))
    rows = T.table(spark, folder, "conversations").select("role", body.alias("value"))
    return E.input_violations(rows, "role", "turn").groupBy(F.col("scope").alias("role")).agg(F.count(F.lit(1)).alias("violations"))


DISTANCE = """WITH req AS (SELECT o_orderkey AS "probeId", (year(o_orderdate) - 1994) * 10 AS cp, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
 d AS (SELECT "probeId", max(cp) AS cp, min(p_size) AS lo, max(p_size) AS hi FROM req LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1) """


@query("a19_session_distance", DISTANCE + """SELECT "probeId", CASE WHEN lo IS NULL THEN 0 WHEN hi <= cp THEN cp - lo END AS "derivedDistance",
 coalesce(CASE WHEN "probeId" > 7000 AND lo IS NOT NULL THEN 3 END, CASE WHEN lo IS NULL THEN 0 WHEN hi <= cp THEN cp - lo END) AS distance FROM d""")
def a19(spark, folder):
    required = T.table(spark, folder, "lineitem").select(
        F.lit("parts").alias("fixtureId"), F.col("l_orderkey").alias("probeId"), F.col("l_partkey").cast("string").alias("factId"))
    labelled = required.filter("probeId > 7000").select("probeId").distinct().withColumn("sessionDistance", F.lit(3))
    probes = T.table(spark, folder, "orders").select(
        F.lit("parts").alias("fixtureId"), F.col("o_orderkey").alias("probeId"),
        ((F.year("o_orderdate") - 1994) * 10).alias("checkpoint")).join(labelled, "probeId", "left")
    key = F.col("p_partkey").cast("string")
    part = T.table(spark, folder, "part").withColumn("fixtureId", F.lit("parts"))
    facts = part.select("fixtureId", key.alias("factId"), F.concat(F.lit("t"), key).alias("introducedAt"))
    turns = part.select("fixtureId", F.concat(F.lit("t"), key).alias("turnId"), F.col("p_size").alias("sessionIndex"))
    return M.session_distance(probes, required, facts, turns).drop("fixtureId")


@query("j02_evidence_violations", """SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON p_partkey = l_partkey WHERE p_partkey IS NULL GROUP BY 1, 2""")
def j02(spark, folder):
    evidence = T.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    known = T.table(spark, folder, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return A.unknown_references(evidence, known, ["l_partkey"]).groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("w01_timestamps_increase", """SELECT * FROM (SELECT user_id AS "runId", event_id AS seq, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE value <= previous""")
def w01(spark, folder):
    rows = T.table(spark, folder, "events").select(F.col("user_id").alias("runId"), F.col("event_id").alias("seq"), "value")
    lagged = running(range_blocks(rows, ["runId"], ["seq"]), ["runId"], ["seq"], lags={"previous": "value"})
    return lagged.filter("value <= previous")


@query("u01_id_namespace", """SELECT id, count(*) AS occurrences FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part UNION ALL SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(*) > 1""")
def u01(spark, folder):
    ids = None
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
        part = T.table(spark, folder, name).select(F.col(key).alias("id"))
        ids = part if ids is None else ids.unionByName(part)
    return A.duplicates(ids, ["id"])


@query("u02_turn_facts", """SELECT "turnId", count(*) AS facts FROM (SELECT l_partkey AS "turnId", CAST(l_suppkey AS VARCHAR) AS f FROM lineitem UNION SELECT l_partkey, l_returnflag FROM lineitem UNION SELECT p_partkey, p_brand FROM part) GROUP BY 1""")
def u02(spark, folder):
    turns = T.table(spark, folder, "lineitem").select(
        F.lit("f").alias("fixtureId"), F.col("l_partkey").alias("turnId"), F.array(F.col("l_suppkey").cast("string")).alias("introducedFactIds"),
        F.array("l_returnflag").alias("referencedFactIds"))
    facts = T.table(spark, folder, "part").select(F.lit("f").alias("fixtureId"), F.col("p_partkey").alias("introducedAt"), F.col("p_brand").alias("factId"))
    return M.turn_facts(turns, facts).groupBy("turnId").agg(F.count(F.lit(1)).alias("facts"))


@query("u06_missing_fields", """SELECT event_id, CASE WHEN value < 50 THEN ['seed', 'runId'] ELSE ['runId'] END AS missing FROM events""")
def u06(spark, folder):
    body = F.when(F.col("value") < 50, F.col("props")).otherwise(F.lit('{"seed":1,"k":2}'))
    return T.table(spark, folder, "events").select("event_id", missing_fields(J.strict(body), ("k", "seed", "runId")).alias("missing"))


@query("f02_parse_number", """SELECT event_type, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click')) AS numbers FROM events GROUP BY 1""")
def f02(spark, folder):
    value = F.col("value").cast("decimal(10,2)").cast("string")
    said = (F.when(F.col("event_type") == "view", F.concat(F.lit(" +"), value, F.lit("E2\t"))).when(F.col("event_type") == "click", value)
            .when(F.col("event_type") == "signup", F.concat(value, F.lit(" liters"))).when(F.col("event_type") == "error", F.lit("NaN"))
            .otherwise(F.concat(F.lit("1,"), value)))
    return T.table(spark, folder, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_number(text.normalize(said))).alias("numbers"))


@query("f09_declines", """SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_nationkey < 10) AS declines FROM customer GROUP BY 1""")
def f09(spark, folder):
    said = (F.when(F.col("c_nationkey") < 5, " I cannot ANSWER this\tquestion!! ").when(F.col("c_nationkey") < 10, "Unknown.")
            .when(F.col("c_nationkey") < 15, "I do not know, but blue.").otherwise(F.col("c_name")))
    return T.table(spark, folder, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(text.is_decline(text.normalize(said))).alias("declines"))


def verdict_rows(spark, folder):
    """Every line item as a judged answer: quantity bands make verdicts well-formed, odd or missing."""
    q = F.col("l_quantity")
    verdict = (F.when(q < 10, F.lit('{"judgment":"pass","requiredClaimCoverage":[true,true],"contradictionFlags":[false],"confidence":1}'))
               .when(q < 15, F.lit('{"judgment":"pass","requiredClaimCoverage":[true,false],"contradictionFlags":[false],"confidence":0.5}'))
               .when(q < 20, F.lit('{"judgment":"abstain","requiredClaimCoverage":[false,false],"contradictionFlags":[true],"confidence":0.25}'))
               .when(q < 25, F.lit('{"judgment":"fail","requiredClaimCoverage":[false],"contradictionFlags":[true],"confidence":0.25}'))
               .when(q < 30, F.lit('{"judgment":"fail","requiredClaimCoverage":[false,true],"contradictionFlags":[true],"confidence":true}'))
               .when(q < 35, F.lit('{"judgment":"maybe"}')).otherwise(
                   F.lit('{"judgment":"fail","requiredClaimCoverage":[false,true],"contradictionFlags":[true],"confidence":0}')))
    none = F.lit(None).cast("string")
    expected = F.struct(F.lit("semantic").alias("matchType"), F.array(F.lit("x")).alias("acceptedAnswers"), F.array(F.lit("a"), F.lit("b")).alias("requiredClaims"),
                        F.array(F.lit("c")).alias("disallowedContradictions"), none.alias("rubric"))
    rows = T.dealt(T.table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("l_quantity"), F.min("l_linestatus").alias("l_linestatus"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").alias("answerability"), F.lit("Blue").alias("answer"),
                       expected.alias("expected"), verdict.alias("output"), F.when(q > 45, "other").otherwise("judge-1").alias("model"))


@query("f11_verdicts", """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, min(l_linestatus) = 'O' AS answerable FROM lineitem GROUP BY 1, 2),
 v AS (SELECT *, CASE WHEN q > 45 THEN 'another judge than the pinned one' WHEN q < 10 THEN NULL WHEN q < 15 THEN 'inconsistent pass' WHEN q < 20 THEN NULL
 WHEN q < 25 THEN 'claim coverage is not one boolean per claim' WHEN q < 30 THEN 'confidence outside 0 to 1' WHEN q < 35 THEN 'no known judgment' END AS "goldError",
 CASE WHEN q < 10 THEN 'pass' WHEN q < 20 THEN 'abstain' ELSE 'fail' END AS j FROM l)
 SELECT l_orderkey, l_linenumber, "goldError", CASE WHEN "goldError" IS NULL THEN j END AS judgment,
 CASE WHEN "goldError" IS NULL THEN (j = 'pass' AND answerable) OR (j = 'abstain' AND NOT answerable) END AS correct FROM v""")
def f11(spark, folder):
    rows = verdict_rows(spark, folder)
    verdicts = rows.select("l_orderkey", "l_linenumber", "output", "model")
    judged = H.apply_verdicts(rows.drop("output", "model"), verdicts, ["l_orderkey", "l_linenumber"], pinned_model="judge-1")
    return judged.select("l_orderkey", "l_linenumber", "goldError", "judgment", "correct")


@query("f13_judge_requests", """SELECT c_custkey, sha256('Judge.' || chr(10) || 'TRUSTED_RUBRIC' || chr(10) || '{"rubricVersion":"r1","rubric":"State it","answerability":true,"requiredClaims":["' || c_mktsegment || '"],"disallowedContradictions":[]}') AS system,
 'BEGIN_UNTRUSTED_DATA' || chr(10) || '{"question":"Which?","candidate":"' || c_name || '"}' || chr(10) || 'END_UNTRUSTED_DATA' AS user FROM customer""")
def f13(spark, folder):
    rows = T.table(spark, folder, "customer").select(
        "c_custkey", F.lit("Which?").alias("question"), F.col("c_name").alias("answer"), F.lit(True).alias("answerability"),
        F.struct(F.lit("semantic").alias("matchType"), F.lit("State it").alias("rubric"), F.array("c_mktsegment").alias("requiredClaims"),
                 F.array().cast("array<string>").alias("disallowedContradictions")).alias("expected"))
    made = H.judge_requests(rows, "Judge.", "r1", "judge-1")
    return made.select("c_custkey", F.sha2("system", 256).alias("system"), "user")


@query("f17_redact_json", """SELECT c_custkey, '{"headers":{"X-Api-Key":"[REDACTED]","note":"Bearer [REDACTED] ok"},"pair":["Authorization","[REDACTED]"],"segment":"' || c_mktsegment || '"}' AS body FROM customer""")
def f17(spark, folder):
    body = F.concat(F.lit('{"headers":{"X-\\u0041pi-Key":"s3","note":"\\u0042earer '), F.col("c_name"), F.lit(' ok"},"pair":["Authorization","'),
                    F.col("c_name"), F.lit('"],"segment":"'), F.col("c_mktsegment"), F.lit('"}'))
    return T.table(spark, folder, "customer").select("c_custkey", redact_json(body).alias("body"))


@query("f18_zoned_timestamps", """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS zoned,
 CAST(coalesce(sum(CASE o_orderpriority WHEN '1-URGENT' THEN epoch(o_orderdate) WHEN '2-HIGH' THEN epoch(o_orderdate) - 7200 END), 0) AS BIGINT) AS seconds FROM orders GROUP BY 1""")
def f18(spark, folder):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    said = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(day, F.lit("Z"))).when(F.col("o_orderpriority") == "2-HIGH", F.concat(day, F.lit("+02:00")))
            .when(F.col("o_orderpriority") == "3-MEDIUM", day).otherwise(F.lit("yesterday")))
    stamp = text.zoned_timestamp(said)
    return T.table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count(stamp).alias("zoned"), F.coalesce(F.sum(F.unix_seconds(stamp)), F.lit(0)).alias("seconds"))


@query("f19_sha256_shape", """SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS shaped FROM orders GROUP BY 1""")
def f19(spark, folder):
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    said = F.when(F.col("o_orderstatus") == "F", digest).when(F.col("o_orderstatus") == "O", F.upper(F.concat(F.lit("a"), digest.substr(2, 63)))).otherwise(digest.substr(1, 63))
    return T.table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(text.is_sha256(said)).alias("shaped"))


@query("f20_strict_integers", """SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_linenumber IN (1, 2)) AS integers FROM lineitem GROUP BY 1""")
def f20(spark, folder):
    n = F.col("l_linenumber")
    body = (F.when(n == 1, F.lit("5")).when(n == 2, F.col("l_orderkey").cast("string")).when(n == 3, F.lit("true")).when(n == 4, F.lit("1.5"))
            .when(n == 5, F.lit('"5"')).otherwise(F.lit("-1")))
    value = J.strict(body)
    strict = J.is_type(value, "INTEGER") & (J.at(value, "$", "bigint") >= 0)
    return T.table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(strict).alias("integers"))


def native_requests(spark, folder):
    """Every conversation turn as a native request: a stable system prefix and the turn's text."""
    message = F.struct(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.lit("contract").alias("content"))
    version = F.struct(F.lit("v1").alias("version"))
    segments = F.array(
        F.struct(F.lit("stable").alias("tier"), F.lit("contract").alias("content"), F.lit(0).alias("tokenCount"), F.array(F.lit(0)).alias("messageIndices")),
        F.struct(F.when(F.col("role") == "system", "other").otherwise("unstable").alias("tier"), F.lit("rest").alias("content"),
                 F.lit(0).alias("tokenCount"), F.array(F.when(F.col("turn") > 5, 4).otherwise(1)).alias("messageIndices")))
    body = F.struct(F.concat_ws("-", "conv_id", "turn").alias("requestId"), version.alias("model"), F.from_json(F.lit('{"t":0}'), "t int").alias("decodingSettings"),
                    F.array(system, message).alias("messages"), segments.alias("tierSegments"))
    return T.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text", F.to_json(body).alias("body"))


@query("e_request_rules", """SELECT 'E12' AS "ruleId", count(*) AS violations FROM conversations WHERE role = 'system' HAVING count(*) > 0 UNION ALL SELECT 'E14', count(*) FROM conversations WHERE turn > 5 HAVING count(*) > 0""")
def e_requests(spark, folder):
    rows = native_requests(spark, folder).withColumn("request", J.strict(F.col("body")))
    return per_rule(E.request_violations(rows, "conv_id"))


@query("e_attribution_rules", """SELECT 'E17' AS "ruleId", count(*) AS violations FROM conversations WHERE turn > 5 HAVING count(*) > 0""")
def e_attribution(spark, folder):
    rows = native_requests(spark, folder).withColumn("request", J.strict(F.col("body"))).withColumn("stablePrefix", F.array(F.lit("contract")))
    return per_rule(E.attribution_violations(rows, "conv_id"))


@query("f21_wire_tokens", """SELECT conv_id, turn, length('{"model":"v1","messages":[{"role":"system","content":"contract"},{"role":"' || CASE role WHEN 'system' THEN 'user' ELSE role END || '","content":' || to_json(text) || '}],"t":0}') AS "wireTokens",
 length('[{"role":"' || CASE role WHEN 'system' THEN 'user' ELSE role END || '","content":' || to_json(text) || '}]') AS "segmentTokens" FROM conversations""")
def f21(spark, folder):
    rows = native_requests(spark, folder).withColumn("w", wire_parts(F.col("body")))
    none = F.array().cast("array<string>")
    segments = F.array(F.struct(F.array(F.lit(1)).alias("messageIndices"), none.alias("toolNames"), F.lit(0).cast("bigint").alias("tokenCount")))
    tools = F.map_from_arrays("w.toolNames", "w.tools")
    counted = A.attribute_tokens(segments, F.col("w.messages"), tools)
    return rows.select("conv_id", "turn", F.char_length("w.body").cast("bigint").alias("wireTokens"),
                       F.element_at(counted, 1)["tokenCount"].alias("segmentTokens"))


@query("f26_prefix_hashes", """SELECT c_custkey, sha256('["' || c_name || '","' || c_mktsegment || '"]') AS request, sha256('["' || c_name || '","' || c_mktsegment || '"]' || chr(10)) AS manifest FROM customer""")
def f26(spark, folder):
    prefix = F.array("c_name", "c_mktsegment")
    return T.table(spark, folder, "customer").select(
        "c_custkey", canonical.prefix_hash(prefix).alias("request"), canonical.manifest_prefix_hash(prefix).alias("manifest"))


@query("f30_same_json", """SELECT event_type, count(*) AS n, count(*) FILTER (event_type <> 'error') AS same FROM events GROUP BY 1""")
def f30(spark, folder):
    left = F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"b":[1,2]}'))
    right = F.concat(F.lit('{"b":['), F.when(F.col("event_type") == "error", "2,1").otherwise("1, 2"), F.lit('], "a":'), F.col("props"), F.lit("}"))
    return T.table(spark, folder, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(canonical.same_json(left, right)).alias("same"))


@query("r_archive_rules", VIEWS + """, run AS (SELECT "runId", CASE WHEN arg_max(event_type, seq) = 'error' THEN 'terminated' WHEN arg_max(event_type, seq) = 'view' THEN 'running' ELSE 'completed' END AS status FROM request GROUP BY 1)
 SELECT * FROM (SELECT 'R01' AS "ruleId", count(*) AS violations FROM request WHERE "totalTokens" > 25000 AND NOT (status = 'error' AND category = 'budget')
 UNION ALL SELECT 'R15', count(*) FROM gold JOIN run USING ("runId") WHERE status = 'completed' AND ("runId", "probeId") NOT IN (SELECT "runId", "probeId" FROM captured)
 UNION ALL SELECT 'R16', count(*) FROM run WHERE status = 'running'
 UNION ALL SELECT 'R17', count(*) FROM gold WHERE ("runId", "probeId") NOT IN (SELECT "runId", "probeId" FROM captured)
 UNION ALL SELECT 'R08', count(*) FROM captured JOIN gold USING ("runId", "probeId") WHERE gold.value > 100
 UNION ALL SELECT 'R10', count(*) FROM captured JOIN gold USING ("runId", "probeId") WHERE "eligibleForAccuracy" AND gold.k > 90) WHERE violations > 0""")
def r_rules(spark, folder):
    requests, gold = T.requests(spark, folder), T.gold(spark, folder)
    last = F.max_by("event_type", "seq")
    lifecycle = requests.groupBy("runId").agg(
        F.when(last == "error", "terminated").when(last == "view", "running").otherwise("completed").alias("status"))
    plan = gold.select("runId", "probeId", F.concat(F.lit("s-"), "k").alias("afterSessionId"))
    seen = gold.select("runId", "probeId", F.when(F.col("value") > 100, "s-x").otherwise(F.concat(F.lit("s-"), "k")).alias("sessionId"), "k")
    captured = T.captured(spark, folder).join(seen, ["runId", "probeId"]).select(
        "runId", "probeId", "sessionId", "status", "category", "eligibleForAccuracy",
        F.when(F.col("k") <= 90, F.col("answer")).alias("answer"), F.array("requestId").alias("requestIds"),
        F.array(F.struct("requestId", F.lit("h").alias("hash"))).alias("requests"))
    return per_rule(R.archive_violations(requests, captured, plan, lifecycle))


@query("k_score_rules", VIEWS + """SELECT * FROM (SELECT 'K10' AS "ruleId", count(*) AS violations FROM score0 WHERE judgment <> 'incomplete' AND value > 150
 UNION ALL SELECT 'K07', count(*) FROM score0 WHERE judgment = 'incomplete' AND value > 150
 UNION ALL SELECT 'K11', count(*) FROM score0 WHERE value BETWEEN 100 AND 105
 UNION ALL SELECT 'K04', count(*) FROM score0 WHERE judgment <> 'incomplete' AND k = 50 AND NOT (value BETWEEN 100 AND 105)
 UNION ALL SELECT 'K02', count(*) FROM score0 WHERE "fixtureId" = 'fx-3' AND NOT (value BETWEEN 100 AND 105)) WHERE violations > 0""")
def k_rules(spark, folder):
    gold, captured = T.gold(spark, folder), T.captured(spark, folder)
    abstains = ~F.col("answerability")
    records = gold.select("runId", "probeId", F.when(abstains, "abstain").otherwise("exact").alias("matchType"), "answerability")
    manifests = gold.select("runId", "fixtureId").distinct().select(
        "runId", F.col("fixtureId").alias("fixtureHash"), F.lit("m").alias("manifestHash"), F.lit("1").alias("scorerVersion"))
    given = T.scores(spark, folder).select("runId", "probeId", "judgment", "correct", "eligibleForAccuracy")
    rows = given.join(gold.select("runId", "probeId", "value", "k", "fixtureId", "answerability"), ["runId", "probeId"]).join(
        captured.select("runId", "probeId", "answer", "category", F.lit(True).alias("_c")), ["runId", "probeId"], "left")
    judged = F.col("judgment") != "incomplete"
    right = (F.col("judgment") == "pass") | (abstains & (F.col("judgment") == "abstain"))
    fair = F.when(judged, right).otherwise(F.lit(False))
    scores = rows.filter("NOT (value BETWEEN 100 AND 105)").select(
        "runId", "probeId", F.when(judged & (F.col("k") == 50), "other").otherwise(F.col("answer")).alias("rawAnswer"),
        F.when(~judged, "not-scored").when(abstains, "abstain").otherwise("exact").alias("matchingMethod"), "judgment",
        F.when(F.col("value") > 150, ~fair).otherwise(fair).alias("correct"), F.lit(None).cast("string").alias("normalizedAnswer"),
        F.lit(None).cast("string").alias("judgeOutput"), "eligibleForAccuracy",
        F.when(F.col("_c").isNull(), "unattempted").otherwise(F.col("category")).alias("failureCategory"),
        F.when(F.col("fixtureId") == "fx-3", "x").otherwise(F.col("fixtureId")).alias("fixtureHash"), F.lit("m").alias("manifestHash"), F.lit("1").alias("scorerVersion"))
    return per_rule(R.score_violations(scores, records, captured, manifests))


@query("m_run_manifest_rules", """SELECT * FROM (SELECT 'M02' AS "ruleId", count(*) AS violations FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'M08', count(*) FROM customer WHERE c_nationkey = 4
 UNION ALL SELECT 'M07', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'M13', count(*) FROM customer WHERE c_nationkey = 5
 UNION ALL SELECT 'M10', count(*) FROM customer WHERE c_nationkey = 6 UNION ALL SELECT 'M14', count(*) FROM customer WHERE c_nationkey = 7) WHERE violations > 0""")
def m_rules(spark, folder):
    """One run manifest per customer, its nation being the fixture; some nations' manifests are wrong."""
    nation = F.col("c_nationkey")
    fixture_hash = F.sha2(nation.cast("string"), 256)
    prefix = F.array(F.lit("contract"), F.col("c_mktsegment"))
    adapter = F.struct(F.lit("a").alias("name"), F.lit("1").alias("revision"), F.when(nation == 3, "1.0").otherwise("2.0").alias("contractVersion"))
    model = F.from_json(F.lit('{"provider":"p","name":"m","version":"v","decoding":{"temperature":0}}'),
                        "provider string, name string, version string, decoding struct<temperature:int>")
    config = [F.concat(F.lit("run-"), F.col("c_custkey")).alias("runId"), adapter.alias("adapter"), model.alias("model"),
              F.struct(F.lit("t").alias("name"), F.lit("1").alias("version")).alias("tokenizer"), prefix.alias("stablePrefix"),
              F.lit("1.0").alias("nativeModelEnvelopeVersion"), nation.alias("seed"), F.lit("1.0.0").alias("scorerVersion"),
              F.sha2(F.lit("h"), 256).alias("harnessHash"), F.when(nation == 6, F.lit("0")).otherwise(fixture_hash).alias("fixtureHash"),
              F.when(F.col("c_acctbal") < 0, 0).otherwise(60).alias("rateLimitRpm"), F.lit(30).alias("probeTimeoutSeconds")]
    hashed = canonical.digest(F.to_json(F.struct(*config)))
    body = F.to_json(F.struct(
        *config, F.when(nation == 5, F.sha2(F.lit("x"), 256)).otherwise(hashed).alias("configHash"),
        F.when(nation == 7, F.sha2(F.lit("x"), 256)).otherwise(canonical.manifest_prefix_hash(prefix)).alias("stablePrefixHash"),
        F.when(nation == 4, "2026-01-01T00:00:00").otherwise("2026-01-01T00:00:00Z").alias("timestamp"),
        F.concat(F.lit("fx-"), nation).alias("fixtureId"), nation.alias("fixtureSeed"), F.lit("1.0.0").alias("generatorVersion")))
    manifests = T.dealt(T.table(spark, folder, "customer")).select(F.col("c_custkey").alias("runId"), body.alias("text"))
    fixtures = T.table(spark, folder, "nation").select(
        F.concat(F.lit("fx-"), F.col("n_nationkey")).alias("fixtureId"), F.sha2(F.col("n_nationkey").cast("string"), 256).alias("contentHash"),
        F.lit("1.0.0").alias("generatorVersion"), F.col("n_nationkey").cast("bigint").alias("seed"))
    return per_rule(run_manifest_violations(manifests, fixtures))


@query("c_calibration_rules", """WITH rows AS (SELECT lang, doc_id, n_chars, toxic, quality, source FROM labels JOIN documents USING (doc_id)),
 n AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS s FROM rows GROUP BY 1)
 SELECT * FROM (SELECT 'C07' AS "ruleId", count(*) AS violations FROM n WHERE n NOT BETWEEN 90 AND 110 UNION ALL SELECT 'C08', count(*) FROM n UNION ALL SELECT 'C09', count(*) FROM n
 UNION ALL SELECT 'C10', count(*) FROM n WHERE s * 10 < n * 3 UNION ALL SELECT 'C16', count(*) FROM rows WHERE n_chars < 300 UNION ALL SELECT 'C21', count(*) FROM rows WHERE source = 'src7'
 UNION ALL SELECT 'C22', count(*) FROM rows WHERE toxic = 1 AND n_chars > 3000 UNION ALL SELECT 'C26', count(*) FROM rows WHERE quality = 0) WHERE violations > 0""")
def c_rules(spark, folder):
    """One corpus per language out of the labelled documents."""
    documents = T.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = T.table(spark, folder, "labels").join(documents, "doc_id")
    none, some = F.array().cast("array<string>"), F.array(F.lit("f1"))
    semantic = F.col("toxic") == 1
    nothing = F.lit(None).cast("string")
    expected = F.struct(
        F.when(semantic, "semantic").otherwise("exact").alias("matchType"), F.array(F.lit("blue")).alias("acceptedAnswers"), some.alias("requiredFactIds"),
        none.alias("forbiddenFactIds"), nothing.alias("targetNumber"), nothing.alias("tolerance"), nothing.alias("toleranceMode"), none.alias("items"),
        F.when(semantic & (F.col("n_chars") <= 3000), "State it").alias("rubric"), some.alias("requiredClaims"), none.alias("disallowedContradictions"))
    evidence = F.array(F.struct(F.lit("f1").alias("factId"), F.when(F.col("n_chars") < 300, 9).otherwise(1).alias("sessionIndex"), F.lit("said").alias("text"),
                                F.when(F.col("source") == "src7", "expired").otherwise("active").alias("state")))
    corpus = rows.select(
        F.col("lang").alias("calibrationSetId"), F.col("doc_id").cast("string").alias("probeId"), F.lit("knowledge-update").alias("ability"), F.lit("Which?").alias("question"),
        F.lit("blue").alias("candidateAnswer"), expected.alias("expected"), F.lit("pass").alias("goldJudgment"), F.lit("said so").alias("justification"),
        F.lit(True).alias("answerability"), F.lit("current").alias("answerAsOf"), F.lit(5).alias("afterSessionIndex"), none.alias("edgeCases"), evidence.alias("evidence"))
    reviews = rows.select(F.col("lang").alias("calibrationSetId"), F.col("doc_id").cast("string").alias("probeId"),
                          F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("confirmedGoldJudgment"),
                          F.lit(True).alias("justificationConsistent"), F.lit(True).alias("evidenceConsistent"), F.lit("note").alias("reviewNote"))
    headers = rows.select(F.col("lang").alias("calibrationSetId")).distinct().select(
        "calibrationSetId", F.lit("calibration-manifest-1.0").alias("manifestSchemaVersion"), F.lit("calibration-1.0").alias("schemaVersion"), F.lit(True).alias("frozen"),
        F.col("calibrationSetId").alias("manifestSetId"), F.col("calibrationSetId").alias("reviewSetId"), F.lit("1").alias("manifestSetVersion"), F.lit("1").alias("calibrationSetVersion"),
        *[F.lit("x").alias(c) for c in ("retainedWithScorerVersion", "frozenAt", "labelingMethod", "reviewMethod", "reviewedAt", "declaredProbesHash", "probesHash",
                                        "declaredReviewHash", "reviewHash", "reviewProbesHash")],
        F.lit(0.95).alias("requiredAgreement"), F.lit("passed").alias("result"))
    return per_rule(R.calibration_violations(corpus, reviews, headers))
