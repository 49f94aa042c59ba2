"""Exact n-gram Jaccard join: documents whose word shingles overlap, and their groups.

Jaccard distance is a metric. In it, almost all pairs of documents are at
distance 1, from each other and from any pivot document, so cells around a
few pivot documents would hold everything and no triangle-inequality window
could close. The first split therefore takes pivots that do separate: single
shingles. A document belongs to the region of each shingle of its boundary
set, the smallest set that a document within the distance must meet: its
n - ceil(s * n) + 1 rarest shingles, in one order for the whole corpus. That
is the replication of boundary documents; two documents within the distance
share a region. Copies are one document throughout.

Small regions (nearly all) compare their documents locally. In a large region
up to PIVOTS central documents are pivots first: documents within the distance
of a pivot join its group, and a region whose documents are all in one group
is done. Distances to these are computed for pairs that sizes and sketches
allow to be near. The other regions are cut into blocks, and the documents of
a block, or of two, are dealt to Voronoi cells around pivots of their own. The
metric there is that of count sketches, which is never above the number of
shingles that two sets do not share. A document of one cell is let into a later
cell if the triangle inequality leaves it near to one there: at most twice the
distance sought farther from that pivot than from its own. Cells are split
again in the same way, until they are small or splitting saves nothing; the
documents in them are compared by group, size and sketch, and what is left by
their texts, unless the distances to the central documents that are known
already keep them apart. No bound loses a link.

Defined cases: a document with fewer words than a shingle has its whole
sequence as its shingle; one without words, or with a null text, has none and
is linked with nothing; rows without doc_id have a null component; rows that
repeat a doc_id are one document if their texts agree, and one component in
any case; ties of distance go to the earlier pivot and change no link; texts
are read whole; an empty table gives an empty result; extra columns of any
name are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import words
from skyloom.llm.common import map_arrow, map_batches, materialise, partitions, slices, utf8
from skyloom.llm.components import components

WIDTH = 5
#: Least similarity, as a ratio of whole numbers.
NEAR = (75, 100)
#: Shingles for each slot of a set's count sketch, about: a half to one.
PER_SLOT = 1
#: Slots of a sketch that are one slot of the coarse one, which travels with pairs.
FOLD = 4
#: One document in so many is counted for the order of shingles, and a shingle
#: found in so many of them counts as frequent. The order only affects speed.
SAMPLE, FREQUENT = 16, 3
FREQUENT_KEPT = 1_000_000
#: Keys that a task remembers.
SEEN = 1_000_000
#: Bytes of sketches that are widened at a time.
GAP_BYTES = 4 << 20
#: Documents of a region that are compared locally without a pivot.
SMALL_REGION = 6
#: Pivots of a large region, and documents of a block of it.
PIVOTS = 4
REGION_BLOCK = 4096
#: Pivots of a block's Voronoi cells, and documents of a cell that are compared without further cells.
CELLS = 8
LEAF = 128


def least_overlap(n: np.ndarray, near: tuple[int, int] = NEAR) -> np.ndarray:
    """Shingles that a near document must share with a set of n."""
    return -(-n * near[0] // near[1])


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in a sample of the documents; bounded by FREQUENT_KEPT."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [words.shingles(*utf8(part.column("text")), width)[1] for part in slices(batch, "text")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64), pa.int64())], ["shingle"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counted = map_arrow(sample, one, "shingle long").groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    kept = counted.orderBy(F.desc("count"), "shingle").limit(FREQUENT_KEPT).select("shingle").toArrow()
    return np.sort(kept.column("shingle").to_numpy().view(np.uint64))


def sketches(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Counts of each set's shingles by leading bits of their hashes, a byte a slot.

    The number of slots is a power of two that grows with the set, so a sketch
    is a small part of its text. A set with over 255 in a slot has no sketch.
    """
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(n, 1) / PER_SLOT))).astype(np.int64)
    size = np.int64(1) << bits
    at = np.cumsum(size) - size
    slot = (h >> (np.uint64(64) - bits.astype(np.uint64))[doc]).astype(np.int64)
    counts = np.bincount(at[doc] + slot, minlength=int(size.sum()))
    full = np.maximum.reduceat(counts, at) > 255 if len(at) else []
    raw = counts.astype(np.uint8).tobytes()
    return [b"" if f else raw[i : i + m] for f, i, m in zip(full, at.tolist(), size.tolist(), strict=True)]


def coarse(sketch: bytes) -> bytes:
    """A sketch with FOLD slots as one; none if a sum is over 255."""
    if not sketch:
        return sketch
    counts = np.frombuffer(sketch, np.uint8).reshape(-1, FOLD).sum(1)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Sketches (..., slots) as they would be with `size` slots."""
    return counts.reshape(*counts.shape[:-1], size, -1).sum(-1) if counts.shape[-1] > size else counts


def sketch_rows(column: pa.Array, length: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The sketches of a column, those of one length as the rows of a matrix, and the row that each stands in there."""
    place, whole = np.zeros(len(column), np.int64), {}
    for size in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == size)
        whole[size], place[rows] = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, size), np.arange(len(rows))
    return whole, place


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of count sketches, row by row (or of all rows of x to one y), at the shorter length.

    Counts are widened to 32 bits in parts of GAP_BYTES, whatever the number of rows.
    """
    size, out = min(x.shape[-1], y.shape[-1]), np.zeros(len(x), np.int64)
    step = max(1, GAP_BYTES // (4 * max(x.shape[-1], y.shape[-1])))
    one = folded(y.astype(np.int32), size) if y.ndim == 1 else None
    for k in range(0, len(x), step):
        other = one if one is not None else folded(y[k : k + step].astype(np.int32), size)
        out[k : k + step] = np.abs(folded(x[k : k + step].astype(np.int32), size) - other).sum(1)
    return out


def most_common(n: np.ndarray, m: np.ndarray, a: pa.Array, b: pa.Array) -> np.ndarray:
    """No fewer shingles than sets of n and m have in common, pair by pair, by their sketches; pairs of the same two lengths together."""
    out = np.minimum(n, m).astype(float)
    lengths = [np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype(np.int64) for c in (a, b)]
    (whole_a, at_a), (whole_b, at_b) = (sketch_rows(c, k) for c, k in zip((a, b), lengths, strict=True))
    both = lengths[0] * (lengths[1].max(initial=0) + 1) + lengths[1]
    for kind in np.unique(both[(lengths[0] > 0) & (lengths[1] > 0)]):
        rows = np.flatnonzero(both == kind)
        p, q = (int(x[rows[0]]) for x in lengths)
        for k in range(0, len(rows), 4096):
            some = rows[k : k + 4096]
            out[some] = (n[some] + m[some] - gaps(whole_a[p][at_a[some]], whole_b[q][at_b[some]])) / 2
    return out


def profiles(docs: DataFrame, width: int, near: tuple[int, int]) -> DataFrame:
    """doc_id, n (set size), key (hash of the set), sketch, coarse sketch, and the boundary shingles.

    Within a task, only the first row of a key that has a doc_id has sketch and
    boundary, or the first since the task forgot SEEN keys.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_last = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                doc, h = words.shingles(*utf8(part.column("text")), width)
                n = np.bincount(doc, minlength=part.num_rows)
                ends = np.cumsum(n)
                starts = ends - n
                key = np.zeros(part.num_rows, np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    key[full] = words.mix(np.add.reduceat(words.mix(h ^ np.uint64(0xA0761D6478BD642F)), starts[full]) + n[full].astype(np.uint64))
                at = np.minimum(np.searchsorted(rare_last, h), max(0, len(rare_last) - 1))
                often = (rare_last[at] == h) if len(rare_last) else np.zeros(len(h), bool)
                order = np.argsort(doc * 2 + often, kind="stable")
                place = np.arange(len(h)) - starts[doc]
                chosen = order[place < (n - least_overlap(n, near) + 1)[doc]]
                cut = np.searchsorted(doc[chosen], np.arange(part.num_rows + 1))
                boundary = h[chosen].view(np.int64)
                marks = sketches(doc, h, n)
                keys = key.view(np.int64).tolist()
                with_id = part.column("doc_id").is_valid().to_pylist()
                sigs: list = []
                sketch: list = []
                for k, x in enumerate(keys):
                    if n[k] and with_id[k] and x not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(x)
                        sigs.append(boundary[cut[k] : cut[k + 1]])
                        sketch.append(marks[k])
                    else:
                        sigs.append(None)
                        sketch.append(None)
                small = [None if x is None else coarse(x) for x in sketch]
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketch, pa.binary()), pa.array(small, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "key", "sketch", "coarse", "boundary"])

    return map_batches(docs, run, "doc_id long, n long, key long, sketch binary, coarse binary, boundary array<long>")


def regions(profile: DataFrame) -> DataFrame:
    """Regions of two or more keys: (region, members, kind).

    kind is 0 for a small region, 1 for a large one in one row, and 2 for rows
    of a region that is too large for one.
    """
    spark = profile.sparkSession
    rows = profile.filter(F.col("boundary").isNotNull()).select(F.explode("boundary").alias("region"), "key")
    dealt = rows.repartition(partitions(spark), "region").sortWithinPartitions("region", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_region, held_key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_large = None  # a region of which full rows have gone out

        def cut(region: np.ndarray, key: np.ndarray, last: bool):
            """Rows of the regions that are complete, and the rest."""
            nonlocal open_large
            fresh = np.ones(len(region), bool)
            fresh[1:] = (region[1:] != region[:-1]) | (key[1:] != key[:-1])
            region, key = region[fresh], key[fresh]
            if not len(region):
                return [], [], [], region, key
            starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            ends = np.append(starts[1:], len(region))
            done = len(starts) if last else len(starts) - 1
            ids, members, kinds = [], [], []
            for i, j in zip(starts[:done].tolist(), ends[:done].tolist(), strict=True):
                part = open_large == region[i]
                if j - i > 1 or part:
                    ids.append(int(region[i]))
                    members.append(key[i:j])
                    kinds.append(2 if part else int(j - i > SMALL_REGION))
            rest = starts[-1] if done < len(starts) else len(region)
            if not last and len(region) - rest > 4096:
                # the open region is large: send what is there, keep its last key to drop repeats
                ids.append(int(region[rest]))
                members.append(key[rest:-1])
                kinds.append(2)
                open_large = region[rest]
                rest = len(region) - 1
            return ids, members, kinds, region[rest:], key[rest:]

        def batch_of(ids, members, kinds):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(members, pa.list_(pa.int64())), pa.array(kinds, pa.int32())], ["region", "members", "kind"])

        for batch in batches:
            region = np.concatenate([held_region, batch.column("region").to_numpy(zero_copy_only=False)])
            key = np.concatenate([held_key, batch.column("key").to_numpy(zero_copy_only=False)])
            ids, members, kinds, held_region, held_key = cut(region, key, False)
            if ids:
                yield batch_of(ids, members, kinds)
        ids, members, kinds, _, _ = cut(held_region, held_key, True)
        if ids:
            yield batch_of(ids, members, kinds)

    return map_batches(dealt, run, "region long, members array<long>, kind int")


def local_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs a < b of the members of small regions."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        members = batch.column("members")
        sizes = np.diff(np.asarray(members.offsets))
        values = np.asarray(members.values)[members.offsets[0].as_py() :]
        ends = np.cumsum(sizes)
        a, b = [], []
        for size in np.unique(sizes):
            rows = values[(ends - sizes)[sizes == size][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            a.append(rows[:, i].ravel())
            b.append(rows[:, j].ravel())
        pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    members = found.filter("kind = 0").select("members").distinct()
    return map_arrow(members, one, "a long, b long").distinct()


def possible(pairs: DataFrame, nodes: DataFrame, near: tuple[int, int]) -> DataFrame:
    """The pairs that sizes and coarse sketches allow to be near."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_a", "n_b"))
        least = -(-(n + m) * near[0] // (near[0] + near[1]))
        keep = least <= np.minimum(n, m)
        keep &= most_common(n, m, batch.column("s_a"), batch.column("s_b")) >= least
        return batch.select(["a", "b"]).filter(pa.array(keep))

    a = nodes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("coarse").alias("s_a"))
    b = nodes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("coarse").alias("s_b"))
    return map_arrow(pairs.join(a, "a").join(b, "b"), one, "a long, b long")


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, common and union (numbers of shingles) of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "text_a", 2 << 20):
                for part in slices(half, "text_b", 2 << 20):
                    both = []
                    for side in ("text_a", "text_b"):
                        texts_of = part.column(side).dictionary_encode()  # a pivot's text stands in many pairs
                        doc, h = words.shingles(*utf8(texts_of.dictionary), width)
                        at = np.searchsorted(doc, np.arange(len(texts_of.dictionary) + 1))
                        sets = [h[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        both.append([sets[i] for i in texts_of.indices.to_pylist()])
                    common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*both, strict=True)], np.int64)
                    union = np.array([len(x) + len(y) for x, y in zip(*both, strict=True)], np.int64) - common
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common), pa.array(union)], ["a", "b", "common", "all"])

    a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return map_batches(pairs.join(a, "a").join(b, "b"), run, "a long, b long, common long, all long")


def large_regions(found: DataFrame) -> DataFrame:
    """(region, key) of the large regions, one region of those that hold the same documents.

    The shingles of a passage have many such regions.
    """
    whole = found.filter("kind = 1").groupBy("members").agg(F.min("region").alias("region"))
    parts = found.filter("kind = 2").select("members", "region")
    return whole.unionByName(parts).select("region", F.explode("members").alias("key")).distinct()


def near_groups(docs: DataFrame, width: int = WIDTH, near: tuple[int, int] = NEAR) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    profile = materialise(profiles(docs, width, near), "profiles")
    with_id = profile.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = materialise(with_id.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("sketch").alias("sketch"), F.max("coarse").alias("coarse")), "nodes")
    found = materialise(regions(with_id), "regions")
    close = F.col("common") * near[1] >= F.col("all") * near[0]

    small = materialise(possible(local_pairs(found), nodes, near), "pairs")
    large = materialise(large_regions(found), "large")
    wanted = small.select(F.col("a").alias("key")).union(small.select(F.col("b").alias("key"))).union(large.select("key")).distinct()
    wanted = wanted.join(nodes.select("key", "doc_id"), "key")
    # rows that repeat a doc_id may differ in text: a key may then have several texts, each is compared
    texts = materialise(docs.join(wanted, "doc_id").select("key", "text"), "texts")

    repeated = with_id.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b")
    repeated = with_id.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("key").alias("b")).filter("a <> b")
    # the small regions' pairs and the pivots of large ones are compared together
    star = possible(pivot_pairs(large), nodes, near)
    tested = materialise(overlaps(small.unionByName(star).distinct(), texts, width), "tested")
    group = components(repeated.union(tested.filter(close).select("a", "b")))
    rest = rest_of_large(large, group, tested, nodes, near)
    links = materialise(overlaps(rest, texts, width).filter(close).select("a", "b"), "links")
    if not links.isEmpty():
        group = components(links.union(group.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    of_node = nodes.select("key", F.col("doc_id").alias("first")).join(group.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    by_key = of_node.join(smallest, "component").select("key", "component_id")
    joined = profile.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_key, "key", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def pivot_pairs(large: DataFrame) -> DataFrame:
    """Each document of a large region with the region's pivots.

    A good pivot is central: the text that others are copies of stands in more
    of their common regions than any copy, which has lost some shingles. So the
    documents are dealt into PIVOTS parts by a hash, and of each part the one
    that stands in most regions is a pivot.
    """
    rows = ranked(large).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PIVOTS)))
    pivots = rows.groupBy("region").agg(*(F.max_by(F.when(F.col("part") == k, F.col("key")), F.when(F.col("part") == k, F.col("rank"))).alias(f"p{k}") for k in range(PIVOTS)))
    rows = large.join(pivots, "region").select("key", F.explode(F.array_compact(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("pivot")).filter("key <> pivot")
    return rows.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()


def ranked(large: DataFrame) -> DataFrame:
    """Rows of large regions with how central the document is: in how many regions it stands."""
    central = large.groupBy("key").agg(F.count("*").alias("in_regions"))
    return large.join(central, "key").withColumn("rank", F.struct("in_regions", F.xxhash64("key", F.lit(1)))).drop("in_regions")


def rest_of_large(large: DataFrame, group: DataFrame, tested: DataFrame, nodes: DataFrame, near: tuple[int, int]) -> DataFrame:
    """Pairs of different groups in large regions that may be near and were not compared.

    Regions with the same central document hold much the same documents; they
    become one cell around it, so that a pair comes out once and not in each.
    A region is cut into blocks, and each block and pair of blocks is joined by
    itself, in Voronoi cells and in bounded memory (possible_pairs). Of what is
    left, a pair goes if |d(x, p) - d(y, p)| is above the distance sought for a
    pivot p that both were compared with; repeated texts of a key count with
    their least distance.
    """
    centres = ranked(large).groupBy("region").agg(F.max_by("key", "rank").alias("centre"))
    cells = large.join(centres, "region").select(F.col("centre").alias("region"), "key").distinct()
    member = cells.join(group.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    open_ = member.groupBy("region").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("size")).filter("c <> d")
    rows = member.join(open_.select("region", "size"), "region").join(nodes.select("key", "n", "sketch"), "key")
    blocks = F.ceil(F.col("size") / REGION_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = rows.select("region", "i", "j", "key", "component", "n", "sketch", "own").repartition(partitions(large.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs_of(part: pa.Table) -> Iterator[pa.RecordBatch]:
            for a, b in possible_pairs(part, near):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            starts = group_starts(held)
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                yield from pairs_of(held.slice(x, y - x))
            held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from pairs_of(held)

    def group_starts(rows: pa.Table) -> list[int]:
        region, i, j = (rows.column(c).to_numpy() for c in ("region", "i", "j"))
        return [0, *(np.flatnonzero((region[1:] != region[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]

    pairs = map_batches(dealt, run, "a long, b long").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    distance = 1 - F.col("common") / F.col("all")
    far = 1 - near[0] / near[1] + 1e-9
    to = tested.select(F.col("a").alias("p"), F.col("b").alias("key"), distance.alias("d")).union(tested.select(F.col("b"), F.col("a"), distance))
    pairs = materialise(pairs, "rest")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    to = to.join(ends, "key", "left_semi").groupBy("key", "p").agg(F.min("d").alias("d")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("p", "d"))).alias("to"))
    a, b = to.select(F.col("key").alias("a"), F.col("to").alias("to_a")), to.select(F.col("key").alias("b"), F.col("to").alias("to_b"))
    shared = F.array_intersect(F.map_keys("to_a"), F.map_keys("to_b"))
    apart = F.exists(shared, lambda p: F.abs(F.element_at("to_a", p) - F.element_at("to_b", p)) > far)
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(~F.coalesce(apart, F.lit(False))).select("a", "b")


class Members(NamedTuple):
    """Documents of a part of a region: their places in the block, set sizes, and sketches brought to one length."""

    at: np.ndarray
    key: np.ndarray
    component: np.ndarray
    n: np.ndarray
    own: np.ndarray  # block
    counts: np.ndarray  # (documents, slots)
    drawn: np.ndarray  # has a sketch

    def take(self, which: np.ndarray) -> Members:
        return Members(*(x[which] for x in self))


def possible_pairs(part: pa.Table, near: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of different groups of a block (or of two blocks) that sizes and sketches allow to be near.

    Distance is that of count sketches, the sum of absolute differences. It is
    a metric and never above the number of shingles that only one of two sets
    has, which for near sets is at most (n + m) * reach, and so at most
    x.n * span for a document x and any that is near to it.
    """
    key, comp, n, own, i, j = (part.column(c).to_numpy() for c in ("key", "component", "n", "own", "i", "j"))
    sketch = part.column("sketch").combine_chunks()
    length = np.asarray(pc.fill_null(pc.binary_length(sketch), 0)).astype(np.int64)
    slots = int(length[length > 0].min()) if (length > 0).any() else 1
    whole, place = sketch_rows(sketch, length)
    counts = np.zeros((len(key), slots), np.int32)
    for size, own_rows in whole.items():
        rows = np.flatnonzero(length == size)
        for k in range(0, len(rows), max(1, GAP_BYTES // (4 * size))):
            some = rows[k : k + max(1, GAP_BYTES // (4 * size))]
            counts[some] = folded(own_rows[place[some]].astype(np.int32), slots)
    every = Members(np.arange(len(key)), key, comp, n, own, counts, length > 0)
    cross = bool(i[0] != j[0])
    reach = (near[1] - near[0]) / (near[0] + near[1])
    span = reach * (1 + near[1] / near[0])

    def apart(x: int, others: np.ndarray) -> np.ndarray:
        """Distances of a document to others, each pair at its shorter sketch's length; 0 without a sketch."""
        out = np.zeros(len(others), np.int64)
        if not length[x]:
            return out
        mine = whole[int(length[x])][place[x]]
        for size in np.unique(length[others][length[others] > 0]).tolist():
            its = np.flatnonzero(length[others] == size)
            for k in range(0, len(its), 1024):
                out[its[k : k + 1024]] = gaps(whole[size][place[others[its[k : k + 1024]]]], mine)
        return out

    def compared(m: Members, mask: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(m.key) - 1):
            rest = slice(k + 1, None)
            ok = (m.component[rest] != m.component[k]) & ((mask[rest] | mask[k]) == full)
            if cross:
                ok &= m.own[rest] != m.own[k]
            total = m.n[k] + m.n[rest]
            least = -(-total * near[0] // (near[0] + near[1]))
            ok &= least <= np.minimum(m.n[k], m.n[rest])
            at = np.flatnonzero(ok)
            if len(at):
                at = at[total[at] - apart(m.at[k], m.at[rest][at]) >= 2 * least[at]]
                left.append(np.minimum(m.key[k], m.key[rest][at]))
                right.append(np.maximum(m.key[k], m.key[rest][at]))
        return np.concatenate(left), np.concatenate(right)

    def cells(m: Members, mask: np.ndarray, full: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Voronoi cells around pivots, with the documents of other cells that their windows let in; each joined by itself."""
        if len(m.key) <= LEAF or full >= 1 << 60:
            yield compared(m, mask, full)
            return
        sample = np.linspace(0, len(m.key) - 1, min(len(m.key), 8 * CELLS)).astype(int)
        chosen, gap = [int(sample[0])], np.abs(m.counts[sample] - m.counts[sample[0]]).sum(1)
        while len(chosen) < CELLS and gap.max() > 0:
            chosen.append(int(sample[gap.argmax()]))
            gap = np.minimum(gap, np.abs(m.counts[sample] - m.counts[chosen[-1]]).sum(1))
        d = np.stack([np.abs(m.counts - m.counts[p]).sum(1) for p in chosen], 1)
        home = d.argmin(1)
        # of two near documents of different cells, that of the earlier one is let into the other's
        enters = (d <= (d.min(1) + 2 * span * m.n)[:, None] + 1e-6) | ~m.drawn[:, None]
        inside = [(home == c) | (enters[:, c] & (home < c)) | (~m.drawn & (home != c)) for c in range(len(chosen))]
        if sum(float(x.sum()) ** 2 for x in inside) > 0.8 * float(len(m.key)) ** 2:  # they lie alike to all pivots: cells would save nothing
            yield compared(m, mask, full)
            return
        for c, x in enumerate(inside):
            if (home[x] == c).any():
                yield from cells(m.take(x), np.where(home[x] == c, mask[x] | (full + 1), mask[x]), full * 2 + 1)

    for a, b in cells(every, np.zeros(len(key), np.int64), 0):
        for at in range(0, len(a), 100_000):
            yield a[at : at + 100_000], b[at : at + 100_000]


def one_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their group; rows without doc_id stay."""
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(keep, F.col("row.doc_id").cast("long") == F.col("kept"), "left_semi").select("row.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
