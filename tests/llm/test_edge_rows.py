"""Every operator and every stage on the same odd table: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import bpe, clusters, contamination, fingerprints, jaccard, knn, langid, mixing, periodic, quality, suffix_dedup, toxicity
from tests.llm.test_operators import LONG

#: Names that operators use, or once used, for columns of their own.
CLASHING = ("_id", "_found", "_kept", "_told", "_score", "_copies", "_copy", "_of", "found", "found_", "id", "kept", "row", "lang_pred", "lang_score", "mark_of", "bucket_of", "mix_size", "copies", "size", "rate", "key", "n", "score")
ROWS = [
    (1, "The house of the water is on the road to the wood.", "en", "a"),
    (1, "The house of the water is on the road to the wood.", "en", "a"),
    (1, "another text under the same number, of other words", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", None, "b"),
    (5, LONG, "en", None),
    (6, LONG, "en", "b"),
    (None, "a text that has no number at all but some words", "en", "a"),
    (None, None, None, None),
    (-(2**63), "x", "en", "a"),
    (2**63 - 1, "12 34 !", None, "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(7) for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "fingerprints": lambda d, x: fingerprints.fingerprints(d),
    "groups": lambda d, x: jaccard.near_groups(d),
    "toxicity": toxicity.toxicity,
    "quality": quality.quality,
    "mix": lambda d, x: mixing.mix(d),
    "bpe": lambda d, x: bpe.bpe_digests(bpe.bpe_encode_decode(d)),
    "counts": lambda d, x: bpe.token_counts(d.withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,text:string>>"))),
    "language": lambda d, x: langid.language_id(d),
    "repeats": lambda d, x: suffix_dedup.remove_repeats(d),
    "runs": lambda d, x: periodic.periodic_runs(d),
    "contamination": lambda d, x: contamination.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text", "key", "found")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_gives_a_row_for_each_row(odd, labels, name):
    found = OPERATORS[name](odd, labels)
    assert sorted(map(str, (r.doc_id for r in found.select("doc_id").collect()))) == sorted(map(str, (r[0] for r in ROWS)))
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (None, [1.0]), (3, None), (4, [None]), (5, [float("inf")]), (6, []), (40, [0.0, 0.0]), (8, [0.5] * 3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("grp", "block", "chunk", "rank", "x", "cell")})
    got = {(r.query_id, r["rank"], r.vec_id): r.score for r in knn.top_products(df).collect()}
    assert got[(20, 1, 8)] == 64 * 32 + 128 * 32 and {k[2] for k in got if k[0] == 40} == {6, 8, 20}
    assert knn.top_products(df.limit(0)).count() == 0
    assert sorted(r.vec_id for r in clusters.clusters(df, width=2).collect()) == [20, 20, 40]
    assert clusters.clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, odd, "")
    last = name == corpus_pipeline.STAGES[-1][0]
    rows = found.collect()
    if not last:
        assert found.columns == odd.columns and all(r[c] == 7 for r in rows for c in CLASHING)
    ids = sorted(map(str, (r.doc_id for r in rows)))
    if name == "ngram_jaccard_join":  # 5 and 6 have one text; the rows of 1 are one document
        assert ids == sorted(map(str, (r[0] for r in ROWS if r[0] != 6)))
    if name in ("suffix_array_dedup", "bpe"):
        assert ids == sorted(map(str, (r[0] for r in ROWS)))
    if name == "language_id":
        assert ids == sorted(map(str, (r[0] for r in ROWS if r[1] and any(map(str.isalpha, r[1])))))
    empty = stage(spark, odd.limit(0), "")
    assert empty.count() == 0 and (last or empty.columns == odd.columns)
