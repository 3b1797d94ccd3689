"""The pipeline's stages one by one, and the whole on the smallest tables."""

import corpus_pipeline

from tests.llm import cases
from tests.llm.test_dedup import brute_classes, lines_kept
from tests.llm.test_tokens import library


def test_stages_in_turn(spark, tmp_path):
    if not cases.has_tables():
        return
    docs = spark.read.parquet(f"{cases.FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near duplicates", "mixing", "byte-level BPE"]

    def after(name, docs):
        out = stages[name](spark, docs, cases.FOLDER)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        return spark.read.parquet(path)

    clean = after("toxicity", docs)
    toxic = {r.doc_id for r in spark.read.parquet(f"{cases.FOLDER}/labels.parquet").filter("toxic = 1").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and len(toxic - kept) > len(toxic) / 2 and len(kept) > 0.85 * docs.count() - len(toxic)

    lines = after("line dedup", clean)
    want = lines_kept([(r.doc_id, r.text) for r in clean.collect()])
    got = lines.collect()
    assert lines.columns == columns and sorted((r.doc_id, r.text) for r in got) == sorted((w[0], w[3]) for w in want)
    assert all(r.n_chars == len(r.text) for r in got)

    single = after("near duplicates", lines)
    classes = brute_classes([(r.doc_id, r.text) for r in got])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({c[1] for c in classes})

    mixed = after("mixing", single)
    texts = {(r.doc_id, r.text) for r in single.collect()}
    assert mixed.columns == columns and all((r.doc_id, r.text) in texts for r in mixed.collect())

    encoded = after("byte-level BPE", mixed)
    other = library()
    text_of = dict((r.doc_id, r.text) for r in single.collect())
    rows = encoded.collect()
    assert len(rows) == mixed.count() and all(r.token_ids == other.encode_ordinary(text_of[r.doc_id]) for r in rows)



def test_empty_documents(spark):
    empty = spark.read.parquet(f"{cases.FOLDER}/documents.parquet").limit(0) if cases.has_tables() else None
    if empty is not None:
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, empty, cases.FOLDER)
            assert out.count() == 0
