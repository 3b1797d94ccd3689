"""Registered queries of this subpackage, each over whole tables with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from mnemoscope.llm import (
    bpe, fingerprints, lexical_search, line_dedup, mixing, near_dedup, packing, pii, prefix_trie, quality_rules, secret_scan, token_counts,
    toxicity)
from mnemoscope.llm.catalog import ORACLES, QUERIES, benchmark, conversations, documents, labels, query  # noqa: F401

RANKS, PIECES, VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


@query("op1_pii", sql=r"""
    WITH patterns(kind, place, re) AS (VALUES
      ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
      ('card', 3, '[0-9]([\x20-]?[0-9])+'), ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]'),
      ('iban', 5, '[A-Z]{2}[0-9]{2}([ ]?[A-Z0-9]){11,30}')),
    texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS (SELECT doc_id, t, kind, place, regexp_extract_all(t, re, 0) AS ms, string_split_regex(t, re) AS gaps FROM texts, patterns),
    each AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found),
    placed AS (SELECT doc_id, t, kind, place, ms[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS a FROM each),
    parts AS (SELECT *, a + length(v) AS b, regexp_replace(v, '[^0-9]', '', 'g') AS ds, replace(v, ' ', '') AS plain FROM placed),
    checked AS (SELECT doc_id, kind, place, a, b FROM parts WHERE CASE kind WHEN 'email' THEN true
      WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: NOT (length(ltrim(p, '0')) < 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') <= '255'))) = 0
      WHEN 'card' THEN length(ds) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda k:
        CASE WHEN (length(ds) - k) % 2 = 0 THEN CAST(ds[k] AS INT) WHEN CAST(ds[k] AS INT) > 4 THEN 2 * CAST(ds[k] AS INT) - 9 ELSE 2 * CAST(ds[k] AS INT) END)) % 10 = 0
      WHEN 'phone' THEN length(ds) BETWEEN 8 AND 15
      ELSE NOT regexp_matches(CASE WHEN a > 0 THEN t[a] ELSE '' END || t[b + 1], '[A-Za-z0-9]')
        AND list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
          lambda x, y: CASE WHEN y < 10 THEN (x * 10 + y) % 97 ELSE (x * 100 + y) % 97 END) = 1 END)
    SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
      count(*) FILTER (kind = 'phone') AS n_phone,
      sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY place, a) FILTER (kind <> 'iban'), '')) AS base_sha256,
      coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY place, a), '') AS spans
    FROM texts LEFT JOIN checked USING (doc_id) GROUP BY doc_id""")
def op1(spark, folder):
    """Personal data in every document."""
    found = pii.find(documents(spark, folder).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{kind}')) as bigint) AS n_{kind}")
              for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"),
                        pii.listed(F.col("pii_spans")).alias("spans"))


@query("op2_byte_bpe")
def op2(spark, folder):
    """Token counts and hashes of every document's ids and of what they decode to."""
    return bpe.roundtrip(documents(spark, folder), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op3_quality_rules")
def op3(spark, folder):
    """Statistics of every document and what the base rules and the learned decision list say of it."""
    rows = documents(spark, folder).select("doc_id", "text")
    judged = quality_rules.judge(rows, quality_rules.fit(rows, labels(spark, folder)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op4_mixing")
def op4(spark, folder):
    """How many words of every document the mix takes, and how often it goes to which output shards."""
    plan = mixing.plan_mix(documents(spark, folder))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.size("draws")).cast("bigint").alias("taken"),
                       F.expr("transform(draws, d -> d.shard)").alias("shards"))


@query("op5_toxicity")
def op5(spark, folder):
    """Toxicity of every document, learned from the labelled rows whose crc32 mod 4 is not 2."""
    rows = documents(spark, folder).select("doc_id", "text")
    scored = toxicity.fit(rows, labels(spark, folder)).transform(rows, keep=["doc_id"])
    return scored.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out"),
                         "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_line_dedup", sql=r"""
    WITH lines AS (
      SELECT doc_id, n, key, line FROM (
        SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents))),
    held AS (SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 20
             GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT l.*, holder IS NOT NULL AND l.doc_id <> holder AS gone FROM lines l LEFT JOIN held USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op6(spark, folder):
    """Every document without the lines that three or more documents share."""
    kept = line_dedup.drop_repeated_lines(documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_near_dedup")
def op7(spark, folder):
    """The class of near-duplicates of every document, and how many documents it has."""
    return near_dedup.classes(documents(spark, folder)).select("doc_id", "class_id", "n_docs")


@query("op8_fingerprints")
def op8(spark, folder):
    """Fingerprints of every document and of its edited text, and how like it and the next document are."""
    return fingerprints.compare_with_next(documents(spark, folder))


@query("op9_token_counts")
def op9(spark, folder):
    """Bytes and tokens of every document, from its token counts at all prefixes."""
    counted = token_counts.prefix_counts(documents(spark, folder).select("doc_id", "text"), public_tokenizers.path(PIECES))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                          token_counts.longest_within(F.col("prefix_steps"), TOKEN_LIMIT).alias("fitting_chars"))


@query("op10_secret_scan")
def op10(spark, folder):
    """Secrets in every document."""
    rows = documents(spark, folder).select("doc_id", "text")
    forest = secret_scan.fit(secret_scan.hide_neighbours(secret_scan.labelled_findings(rows)))
    found = secret_scan.scan(rows, forest)
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s.start, s.end)), ",")
    return found.select("doc_id", F.size("candidates").cast("bigint").alias("n_candidates"),
                        F.size("secrets").cast("bigint").alias("n_secrets"), spans.alias("secrets"),
                        F.coalesce(F.array_max(F.transform("candidates", lambda s: s.score)), F.lit(0.0)).alias("top_score"))


# The cyclic redundancy check has no function in DuckDB: eight steps for every digit of the id.
_CRC_BIT = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"


@query("op11_prefix_trie", sql=f"""
    WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, strlen(coalesce(text, '')) AS bytes
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT DISTINCT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
        lambda crc, d: list_reduce([CAST(0 AS BIGINT) for b in range(8)], lambda v, b: {_CRC_BIT}, xor(crc, d)), CAST(4294967295 AS BIGINT))) % 9 AS h FROM own),
    head AS (SELECT convs.c, o.i AS d, turn, bytes, h FROM convs JOIN own o ON o.c = base AND o.i <= h),
    heads AS (SELECT c, count(*) AS n FROM head GROUP BY c),
    turns AS (SELECT c, d, turn, bytes FROM head UNION ALL
      SELECT o.c, o.i - h + coalesce(n, 0), turn, bytes FROM own o JOIN convs USING (c) LEFT JOIN heads USING (c) WHERE o.i > h),
    sized AS (SELECT convs.c, count(d) AS n FROM convs LEFT JOIN turns USING (c) GROUP BY convs.c),
    paths AS (SELECT c, d, sha256(string_agg(turn, ',') OVER (PARTITION BY c ORDER BY d)) AS k, bytes FROM turns
      UNION ALL SELECT c, 0, 'root', 0 FROM convs),
    nodes AS (SELECT k, d, min(c) AS c, count(*) AS m, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '')) AS ends FROM paths JOIN sized USING (c) GROUP BY k, d),
    edges AS (SELECT DISTINCT b.k, a.k AS parent FROM paths a JOIN paths b ON a.c = b.c AND b.d = a.d + 1),
    below AS (SELECT DISTINCT a.k, b.k AS inner_k FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
    fans AS (SELECT parent AS k, count(*) AS n FROM edges GROUP BY parent),
    sums AS (SELECT below.k, count(*) FILTER (f.n IS NULL) AS leaves, sum((x.m - 1) * x.bytes) AS saved
      FROM below JOIN nodes x ON x.k = inner_k LEFT JOIN fans f ON f.k = inner_k GROUP BY below.k)
    SELECT nodes.c AS conv_id, nodes.d AS depth, p.c AS parent_conv_id, nodes.m AS n_convs, coalesce(f.n, 0) AS n_children,
      leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, nodes.ends AS ends_sha256
    FROM nodes JOIN sums USING (k) LEFT JOIN fans f USING (k) LEFT JOIN edges USING (k) LEFT JOIN nodes p ON p.k = parent""")
def op11(spark, folder):
    """The prefix trie of all conversations, each rebuilt with the head of its base."""
    return prefix_trie.trie(conversations(spark, folder))


@query("op12_packing")
def op12(spark, folder):
    """Pieces of all documents in sequences of binary lengths."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    pieces = packing.pack(documents(spark, folder), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, packing.special_tokens(vocabulary))
    return pieces.drop("token_ids")


@query("op13_lexical_search", sql=r"""
    WITH terms AS (SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT *, row_number() OVER () AS r FROM documents)),
    wanted AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
    lengths AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY r),
    total AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS length FROM lengths),
    tfs AS (SELECT r, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term),
    scores AS (SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // length)))) AS BIGINT) AS score
      FROM tfs JOIN wanted USING (term) JOIN weights USING (term) JOIN lengths USING (r), total GROUP BY q, item_id, doc_id, r)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50""")
def op13(spark, folder):
    """The best documents of every benchmark item."""
    return lexical_search.search(documents(spark, folder), benchmark(spark, folder))
