"""Exact top-k inner products by a Voronoi kNN join.

Greatest inner product becomes nearest neighbour: with one more coordinate,
sqrt(M^2 - |x|^2) for a vector x of data, all data lie on a sphere of radius M.
A query is scaled to length M, which changes no order of its products, and gets
0 there, so queries lie on the sphere too; a distance falls as the product
grows. Data have pivots, about as many as the square root of their number, and
so have queries. Each group of queries has a bound on the distance to any of its
queries' k-th neighbour, from the summaries of the data's cells (their k least
distances to their pivot) and the distances between pivots. A data vector is
sent to a group only if the triangle inequality over the group's pivot leaves
it within that bound; what is sent is compared exactly, in blocks of bounded
size.

Defined cases: null vectors, vectors with null or non-finite components and
rows without vec_id take no part; shorter vectors count as padded with 0;
rows that repeat a vec_id are one vector, the least; ties go to the smaller
vec_id; fewer than k other rows give fewer results; a query without length has
score 0 with all others and so the smallest vec_ids; an empty table gives an
empty result; extra columns of any name are ignored. Components may be of any
size: products are exact, and one beyond 64 bits counts as the nearest 64-bit
number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialise

#: Pivots of data, least and most; between these, the square root of the number
#: of vectors. Pivots of queries: one for so many, within their own limits.
DATA_PIVOTS = (16, 1024)
QUERIES_A_PIVOT, QUERY_PIVOTS = 256, (4, 512)
#: Vectors that pivots are chosen from, for each pivot.
SAMPLE_A_PIVOT = 8
#: Queries and data vectors that one task compares at a time, about.
QUERY_CHUNK = 2048
DATA_BLOCK = 32_768


class Space(NamedTuple):
    dim: int
    radius2: float  # M^2
    pivots: np.ndarray  # of data (pivots, dim + 1), on the sphere
    centres: np.ndarray  # of queries, on the sphere
    kind: type  # of numbers in which products are exact


def scaled(embeddings: DataFrame, scale: float) -> DataFrame:
    """vec_id and x = floor(scale * component) as doubles, of the vectors that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))
    return rows.select(F.col("vec_id").cast("long"), x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with 0 to dim."""
    at = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values, dtype=float)[at[0] : at[-1]]
    at = at - at[0]
    if (np.diff(at) == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    sizes = np.diff(at)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(at[:-1], sizes)] = values
    return out


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points (fewer if they coincide), each the farthest from those before it."""
    chosen, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def between(n: float, limits: tuple[int, int]) -> int:
    return int(min(max(n, limits[0]), limits[1]))


def space(data: DataFrame, queries: DataFrame) -> Space:
    """Pivots by farthest-first choice among bounded samples, and the data's extent."""
    norm2 = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    n, dim, most, radius2 = data.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.max(norm2)).first()
    dim, most, radius2 = int(dim or 0), float(most or 0), float(radius2 or 0)
    bound = dim * most * most
    kind = float if bound < 2**53 else np.int64 if bound < 2**63 else object

    def sample(rows: DataFrame, size: int) -> np.ndarray:
        return matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow().column("x").combine_chunks(), dim)

    if kind is object:  # products may be beyond 64 bits and then tie: no distances, every group gets all data
        return Space(dim, radius2, np.zeros((1, dim + 1)), np.zeros((1, dim + 1)), kind)
    wanted = between(n**0.5, DATA_PIVOTS)
    pivots = farthest_first(lifted(sample(data, wanted * SAMPLE_A_PIVOT), radius2), wanted)
    wanted = between(queries.count() / QUERIES_A_PIVOT, QUERY_PIVOTS)
    x = sample(queries, wanted * SAMPLE_A_PIVOT)
    return Space(dim, radius2, pivots, farthest_first(stretched(x, radius2), wanted) if len(x) else pivots[:1], kind)


def lifted(x: np.ndarray, radius2: float) -> np.ndarray:
    """Data vectors with the coordinate that puts them on the sphere."""
    return np.concatenate([x, np.sqrt(np.maximum(radius2 - (x * x).sum(1), 0))[:, None]], 1)


def stretched(x: np.ndarray, radius2: float) -> np.ndarray:
    """Queries on the sphere."""
    size = np.sqrt((x * x).sum(1))[:, None]
    return np.concatenate([x * np.divide(np.sqrt(radius2), size, out=np.zeros_like(size), where=size > 0), np.zeros((len(x), 1))], 1)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(points, pivots) distances."""
    d2 = (points**2).sum(1)[:, None] + (to**2).sum(1)[None] - 2 * points @ to.T
    return np.sqrt(np.maximum(d2, 0))


def summaries(data: DataFrame, queries: DataFrame, sp: Space, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query group: greatest distance to its pivot, bound on the k-th neighbour, number of queries.

    What comes to the driver is k numbers for each pivot.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for part in (batch.slice(i, 2048) for batch in batches for i in range(0, batch.num_rows, 2048)):
            d = distances(lifted(matrix(part.column("x"), sp.dim), sp.radius2), sp.pivots)
            cell, own = d.argmin(1), d.min(1)
            for j in np.unique(cell).tolist():
                best[j] = np.sort(np.concatenate([best.get(j, np.zeros(0)), own[cell == j]]))[:k]
        if best:
            cells = np.repeat(np.array(list(best), np.int32), [len(b) for b in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.concatenate(list(best.values())), pa.float64())], ["cell", "d"])

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(stretched(matrix(batch.column("x"), sp.dim), sp.radius2), sp.centres)
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1), pa.float64())], ["cell", "d"])

    order = Window.partitionBy("cell").orderBy("d")
    near = data.mapInArrow(least, "cell int, d double").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()
    wide, count = np.zeros(len(sp.centres)), np.zeros(len(sp.centres), np.int64)
    for r in queries.mapInArrow(widest, "cell int, d double").groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():
        wide[r.cell], count[r.cell] = r.d, r.n
    cell, d = np.array([r.cell for r in near], np.int64), np.array([r.d for r in near])
    bound = np.full(len(sp.centres), np.inf)
    if len(d) >= k:
        gap = distances(sp.centres, sp.pivots)
        for g in range(len(bound)):  # any query of the group is at most so far from these vectors
            bound[g] = wide[g] + np.partition(gap[g, cell] + d, k - 1)[k - 1]
    return wide, bound, count


def sendings(x: np.ndarray, sp: Space, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of the data vectors that may be among a group's neighbours."""
    if sp.kind is object:
        return np.nonzero(np.broadcast_to(reach >= 0, (len(x), len(reach))))
    return np.nonzero(distances(lifted(x, sp.radius2), sp.centres) <= reach[None])


def top_products(embeddings: DataFrame, k: int = 20, scale: float = 64.0, is_query: F.Column | None = None) -> DataFrame:
    """The k greatest integer inner products of each query with all other vectors.

    Queries are the rows for which is_query holds (default: vec_id divisible by
    20). Returns query_id, rank (from 1), vec_id, score.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    data = materialise(scaled(embeddings, scale), "vectors")
    every = data.filter(is_query)
    has_length = F.exists("x", lambda v: v != 0)
    queries, zero = every.filter(has_length), every.filter(~has_length)
    n = data.count()
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    sp = space(data, queries)
    if sp.kind is not object:
        wide, bound, n_queries = summaries(data, queries, sp, k + 1)  # the query itself is among the data
        slack = 1e-6 * (1 + np.sqrt(sp.radius2))
    else:
        wide, bound, n_queries, slack = np.zeros(1), np.full(1, np.inf), np.array([queries.count()]), 0.0
    chunks = np.maximum(1, -(-n_queries // QUERY_CHUNK))
    blocks = max(1, -(-n // DATA_BLOCK))
    reach = np.where(n_queries > 0, bound + wide + slack, -1.0)

    def place_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                row, group = sendings(matrix(part.column("x"), sp.dim), sp, reach)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(row)), part.column("x").take(pa.array(row)), pa.array(group, pa.int32())], ["vec_id", "x", "grp"])

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), sp.dim)
            group = distances(stretched(x, sp.radius2), sp.centres).argmin(1) if sp.kind is not object else np.zeros(len(x), int)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(group, pa.int32())], ["vec_id", "x", "grp"])

    def compare(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(s):
            s = s.sort_values("vec_id")
            ids = s.vec_id.to_numpy()
            a, b = (matrix(pa.array(f.x, pa.list_(pa.float64())), sp.dim) for f in (q, s))
            if sp.kind is object:  # whole numbers of any size
                a, b = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (a, b))
            else:
                a, b = a.astype(sp.kind), b.astype(sp.kind)
            for i in range(0, len(q), 256):
                product = a[i : i + 256] @ b.T
                if sp.kind is object:
                    product = np.minimum(np.maximum(product, -(2**63)), 2**63 - 1)
                product = product.astype(np.int64)
                for row, own in zip(product, q.vec_id.to_numpy()[i : i + 256], strict=True):
                    at = np.flatnonzero(ids != own)
                    values = row[at]
                    if len(at) > k:
                        least = np.partition(values, len(at) - k)[len(at) - k]
                        at, values = at[values >= least], values[values >= least]
                    best = np.argsort(~values, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at[best]], "score": values[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    group = "vec_id long, x array<double>, grp int"
    n_chunks = F.element_at(F.lit([int(c) for c in chunks]), F.col("grp") + 1)
    chunk, block = F.pmod(F.xxhash64("vec_id"), n_chunks).cast("int"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    s = data.mapInArrow(place_data, group).withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), (n_chunks - 1).cast("int"))))
    q = queries.mapInArrow(place_queries, group).withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["grp", "chunk", "block"]
    found = q.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score long")
    first = [r.vec_id for r in data.orderBy("vec_id").limit(k + 1).collect()]  # all that a query without length can have
    none = zero.select(F.col("vec_id").alias("query_id"), F.explode(F.lit(first)).alias("vec_id"), F.lit(0).cast("long").alias("score")).filter("query_id <> vec_id")
    found = found.union(none)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
