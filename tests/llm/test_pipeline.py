"""The pipeline, stage by stage, against brute-force versions of what each decides."""

import corpus_pipeline
from skyloom.llm import langid
from tests.llm.test_operators import SCHEMA, brute_groups, brute_removed, corpus


def test_stages(spark, tmp_path):
    rows = corpus(8, 48)
    sf = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{sf}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "bpe"]

    told = by["language_id"](spark, docs, sf)
    letters = {r[0] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    assert {r.doc_id for r in told.collect()} == letters and told.columns == docs.columns
    assert told.filter(f"lang = '{langid.UNDETERMINED}'").count() == 0

    groups = brute_groups(rows)
    single = by["ngram_jaccard_join"](spark, docs, sf)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    cut = by["suffix_array_dedup"](spark, docs, sf).collect()
    kept = brute_removed(rows)
    assert {r.doc_id: r.text for r in cut} == {i: k[3].decode("utf-8", "ignore") for i, k in kept.items()}
    assert all(r.n_chars == len(r.text) for r in cut)

    mixed = by["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.filter("text is null").count() == 0

    done = corpus_pipeline.run(spark, sf)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and done.count() > 0


def test_no_documents(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
