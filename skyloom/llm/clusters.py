"""Centroid clustering with exact integer arithmetic and an annulus search for the nearest centroid.

Vectors are whole numbers, floor(scale * component). By the triangle
inequality a centroid within distance u of a vector has a norm within u of the
vector's own. Centroids are sorted by norm; the one nearest in norm gives a
vector its first bound u, a binary search finds the annulus of centroids that
the bound leaves, and these are compared exactly, from the nearest norm
outwards, each closer one narrowing the annulus further. Bounds are widened by
more than the rounding of norms, so a centroid at the same distance is never
left out and ties go to the smaller number.

A round is one pass over the vectors: a task assigns its vectors and adds them
up by cluster, so what is shuffled and what reaches the driver are sums, a few
rows for each task and centroid. Sums are carried as 32-bit limbs, so they are
exact at any number of vectors. The driver holds centroids only: their number
and width are parameters. Assignments of a round are not stored, a lost
executor's vectors are read again.

Defined cases: vectors that are null, have another number of components, or
null or non-finite ones (also after scaling) take no part; rows that repeat a
vec_id are vectors of their own; rows without vec_id are vectors too, and come
last among those that centroids start from; of rows with equal hashes the one
with smaller components does; with fewer vectors than centroids there are as
many centroids as vectors; equal centroids are told apart by their number, so
the later one stays empty, and an empty centroid stays where it is; an empty
table gives an empty result; extra columns of any name are ignored. Components
may be of any size: distances are compared exactly, and a distance or a sum of
distances beyond 64 bits is given as the greatest 64-bit number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialise

#: Centroids, rounds after which they are moved, components of a vector.
CENTROIDS = 16
ROUNDS = 3
WIDTH = 64
#: Vectors that a task assigns at a time, and adds up before it sends sums on.
BLOCK = 16_384
#: Components up to this size have squared distances within 64 bits, for widths up to 1,024.
SMALL = 1 << 25
#: Whole numbers up to this size are exact as doubles.
EXACT = 1 << 53
MOST = 2**63 - 1


def whole_vectors(embeddings: DataFrame, width: int, scale: float) -> DataFrame:
    """vec_id and x, the whole numbers (as doubles, which hold them exactly) of the vectors that take part."""

    def whole(v: Column) -> Column:
        scaled = v.cast("double") * F.lit(float(scale))
        # floor gives a long: doubles that are too large for one are whole numbers as they are
        return F.when(F.abs(scaled) < float(EXACT), F.floor(scaled).cast("double")).otherwise(scaled)

    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size("embedding") == width, F.transform("embedding", whole)).alias("x"))
    return rows.filter(F.col("x").isNotNull() & ~bad)


def first_centroids(vectors: DataFrame, n: int, mark: Column) -> list[list[int]]:
    """The n vectors of smallest mark, in its order: the only vectors that reach the driver."""
    rows = vectors.select("x", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "x").limit(n).collect()
    return [[int(v) for v in r.x] for r in rows]


def numbers(x: np.ndarray, largest: float) -> np.ndarray:
    """Whole numbers in the narrowest kind that is exact for squared distances."""
    if largest <= SMALL:
        return x.astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel().tolist()]
    return out


class Centroids:
    """Centroids in order of their norm."""

    def __init__(self, values: list[list[int]]):
        self.values = np.empty((len(values), len(values[0])), object)
        self.values[:] = values
        norms = np.array([float(sum(v * v for v in c)) for c in values]) ** 0.5
        self.order = np.lexsort((np.arange(len(values)), norms))
        self.norm = norms[self.order]
        self.largest = float(max(abs(v) for c in values for v in c))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of, and squared distance (Python numbers where 64 bits are too few) to, the nearest centroid of each row."""
        n = len(x)
        largest = max(self.largest, float(np.abs(x).max(initial=0)))
        rows, centres = numbers(x, largest), self.values[self.order] if largest > SMALL else self.values[self.order].astype(np.int64)

        def distance(which: np.ndarray, place: np.ndarray) -> np.ndarray:
            gap = rows[which] - centres[place]
            return (gap * gap).sum(1)

        norm = np.sqrt((x * x).sum(1))
        slack = 1e-9 * (norm + self.norm[-1]) + 1e-9
        right = np.searchsorted(self.norm, norm)
        low, high = np.maximum(right - 1, 0), np.minimum(right, len(self.norm) - 1)
        start = np.where(norm - self.norm[low] <= self.norm[high] - norm, low, high)
        best, place = distance(np.arange(n), start), start.copy()
        bound = np.sqrt(best.astype(float)) * (1 + 1e-9) + slack
        first, last = np.searchsorted(self.norm, norm - bound, "left"), np.searchsorted(self.norm, norm + bound, "right")
        # outwards from the first one, on both sides, while the annulus goes on
        for side in (-1, 1):
            at, open_ = start + side, np.arange(n)
            while len(open_):
                k = at[open_]
                inside = (k >= first[open_]) & (k < last[open_])
                open_, k = open_[inside], k[inside]
                near = np.abs(self.norm[k] - norm[open_]) <= bound[open_]
                open_, k = open_[near], k[near]
                if not len(open_):
                    break
                d = distance(open_, k)
                better = (d < best[open_]) | ((d == best[open_]) & (self.order[k] < self.order[place[open_]]))
                won = open_[better]
                best[won], place[won] = d[better], k[better]
                bound[won] = np.sqrt(best[won].astype(float)) * (1 + 1e-9) + slack[won]
                at[open_] += side
        return self.order[place], best


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their vectors as rows of doubles."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, np.asarray(part.column("x").flatten(), float).reshape(-1, width)


def limbs(total: np.ndarray) -> list[np.ndarray]:
    """Whole numbers of any size as sums of longs times powers of 2 ** 32, the last of which is signed."""
    out = []
    while True:
        low = np.array([int(v) & 0xFFFFFFFF for v in total], object)
        rest = np.array([int(v) >> 32 for v in total], object)
        if all(-(2**31) <= v < 2**31 for v in rest):
            return [*out, low.astype(np.int64), rest.astype(np.int64)]
        out.append(low.astype(np.int64))
        total = rest


def moved(vectors: DataFrame, centroids: Centroids, width: int) -> list[list[int]]:
    """Each centroid as the floor of the mean of its vectors; one without vectors as it was."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    count = len(centroids.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, n = np.zeros((count, width), object), np.zeros(count, np.int64)
        for _, x in blocks(batches, width):
            of, _ = c.nearest(x)
            whole = numbers(x, float(np.abs(x).max(initial=0)))
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(of) else np.zeros(0, int)
            if len(starts):
                sums[of[order][starts]] += np.add.reduceat(whole[order], starts, 0).astype(object)
            n += np.bincount(of, minlength=count)
        rows = [(int(k), j, int(n[k]) if j == 0 else 0, part) for k in np.flatnonzero(n) for j, part in enumerate(limbs(sums[k]))]
        if rows:
            cluster, limb, size, parts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(limb, pa.int32()), pa.array(size, pa.int64()), pa.array(list(parts), pa.list_(pa.int64()))], ["cluster", "limb", "n", "sums"])

    partial = vectors.select("x").mapInArrow(run, "cluster int, limb int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = [[int(v) for v in c] for c in centroids.values]
    found: dict[int, tuple[int, list[int]]] = {}
    for r in partial.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *total).collect():
        n, sums = found.get(r.cluster, (0, [0] * width))
        found[r.cluster] = n + r.n, [s + (int(r[f"s{i}"]) << (32 * r.limb)) for i, s in enumerate(sums)]
    for k, (n, sums) in found.items():
        out[k] = [s // n for s in sums]
    return out


def clusters(embeddings: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = 64.0) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part.

    Centroids start as the n vectors with the smallest sha256 of '1:' and the
    vec_id, are moved in each round, and vectors are assigned once more.
    """
    vectors = whole_vectors(embeddings, width, scale)
    start = first_centroids(vectors, n, F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    schema = "vec_id long, cluster int, distance long"
    if not start:
        assigned = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        marks: list[str] = []
    else:
        centroids = Centroids(start)
        for _ in range(rounds):
            centroids = Centroids(moved(vectors, centroids, width))
        shared = embeddings.sparkSession.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in blocks(batches, width):
                of, best = shared.value.nearest(x)
                distance = np.minimum(best, MOST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(of, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

        assigned = materialise(vectors.mapInArrow(run, schema), "clusters")
        marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.values]
    capped = lambda x: F.least(x, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("own"))
    # a row for each centroid, with the sum over all of them
    every = own.agg(F.collect_list(F.struct(F.col("cluster").alias("of"), "own")).alias("each"), F.sum("own").alias("every")).select("every", F.inline("each"))
    known = every.select("of", capped(F.col("own")).alias("cluster_inertia"), capped(F.col("every")).alias("inertia"))
    sha = F.element_at(F.lit(marks or [""]), F.col("cluster") + 1)
    joined = assigned.join(F.broadcast(known), F.col("cluster") == F.col("of"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))
