"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, clusters, contamination, fingerprints, jaccard, knn, langid, mixing, periodic, quality, suffix_dedup, toxicity
from skyloom.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_leaves", "edited_spans")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_products(table(spark, sf_dir, "embeddings"), k=20, scale=64.0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(bpe.bpe_encode_decode(table(spark, sf_dir, "documents")))


def middle_edit() -> F.Column:
    """The edit of query op8: a tenth of the text, from its middle on, gives way to the text's first 24 code points."""
    n = F.char_length("text")
    start = F.floor(n / 2).cast("int")
    return F.array(F.struct(start.alias("start"), (start + F.ceil(n / 10)).cast("int").alias("stop"), F.substring("text", 1, 24).alias("text")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents").withColumn("edits", middle_edit()))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def planted(doc_ids: list, count: np.ndarray) -> np.ndarray:
    """The word that is read in each word's place: from a word on, a tenth of the texts repeat their own words, see op11's contract.

    Texts without doc_id are read as they stand.
    """
    read = np.arange(int(count.sum()))
    for start, n, doc_id in zip((np.cumsum(count) - count).tolist(), count.tolist(), doc_ids, strict=True):
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        read[start + a : start + n] = start + a + np.arange(n - a) % period
    return read


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), reading=planted)
    one, lines = F.col("one"), F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("one", periodic.longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        one["start"].alias("start"),
        one["length"].alias("length"),
        one["period"].alias("period"),
        F.expr("(1000 * one.length) DIV one.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_jaccard": op2_jaccard,
    "op3_topk": op3_topk,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_language": op9_language,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_decontamination": op13_decontamination,
}


def _rounds(n: int) -> str:
    """Common table expressions of n rounds of op12: a0, c1, a1, ... cn, an from the first centroids c0."""
    out = []
    for k in range(n + 1):
        if k:
            out.append(
                f"""m{k} AS (SELECT c, i, CAST(floor(sum(v.x[i]) / count(*)) AS DOUBLE) m FROM a{k - 1} JOIN v USING (vec_id), range(1, 65) g(i) GROUP BY ALL),
c{k} AS (SELECT c, coalesce(y, x) x FROM c{k - 1} LEFT JOIN (SELECT c, list(m ORDER BY i) y FROM m{k} GROUP BY c) USING (c))"""
            )
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c{k}.x) + list_dot_product(c{k}.x, c{k}.x) d FROM v, c{k}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
    return ",\n".join(out)


SQL: dict[str, str] = {
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id query_id, d.vec_id, CAST(list_dot_product(q.x, d.x) AS BIGINT) score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20""",
    "op12_centroid_clusters": f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 c, x FROM (SELECT sha256('1:' || vec_id) h, x FROM v ORDER BY h NULLS LAST, x LIMIT 16)),
{_rounds(3)}
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) cluster_inertia, CAST(sum(d) OVER () AS BIGINT) inertia, sha256(array_to_string(list_transform(c3.x, lambda x: CAST(x AS BIGINT)), ',')) centroid_sha256
FROM a3 JOIN c3 USING (c)""",
    "op13_decontamination": """
WITH lower_d AS (SELECT row_number() OVER () n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
lower_i AS (SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') win FROM lower_i, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) i) WHERE len(w) > 0),
dw AS (SELECT n, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') win FROM lower_d, (SELECT DISTINCT size FROM iw), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) i)),
hit AS (SELECT n, i, size, item_id FROM dw JOIN iw USING (size, win)),
by_word AS (SELECT n, count(DISTINCT p) n_hit FROM (SELECT n, unnest(range(i, i + size)) p FROM (SELECT DISTINCT n, i, size FROM hit)) GROUP BY n),
by_item AS (SELECT n, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT n, item_id FROM hit) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM lower_d LEFT JOIN by_word USING (n) LEFT JOIN by_item USING (n)""",
}
