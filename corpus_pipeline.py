"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, mixing, byte-level BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns what stays.  All but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import functions as F

from mnemoscope.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from mnemoscope.llm.catalog import labels
from mnemoscope.session import scratch_folder

REJECT_AT = 0.3


def without_toxic(spark, docs, sf_dir):
    """Documents that the toxicity score leaves below the threshold; null and empty texts are scored too."""
    from mnemoscope.llm.catalog import labels

    model = toxicity.fit(docs, labels(spark, sf_dir))
    packed = docs.select("text", F.struct("*").alias("_whole"))
    return model.transform(packed, keep=["_whole"]).filter(F.col("score") < REJECT_AT).select("_whole.*")


def without_repeated_lines(spark, docs, sf_dir):
    """All documents, without the lines that three or more share; n_chars follows the text."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("_whole"))
    kept = line_dedup.drop_repeated_lines(packed)
    changed = F.col("n_dropped") > 0
    whole = F.col("_whole").withField("text", F.when(changed, F.col("kept_text")).otherwise(F.col("_whole.text")))
    if "n_chars" in docs.columns:
        whole = whole.withField("n_chars", F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("_whole.n_chars")))
    return kept.select(whole.alias("_whole")).select("_whole.*")


def without_near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-duplicates."""
    return near_dedup.deduplicate(docs)


def mixed(spark, docs, sf_dir):
    """Whole documents as often as the mix of sources takes them, dealt to shards and shuffled inside."""
    return mixing.mix(docs)


def encoded(spark, docs, sf_dir):
    """Token ids of every text in place of the text."""
    tokens = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.withColumn("n_tokens", F.size("token_ids").cast("bigint")).drop("text")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

# Scores, signatures and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_folder(spark, f"stage-{number + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
