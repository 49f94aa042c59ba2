"""Document fingerprints: a Merkle tree over segments, paragraphs and sections.

Leaves are segments of a line (a sentence, cut after a word if it is long),
a paragraph is a line, a section a run of paragraphs that ends with a blank
line or after a paragraph whose digest says so (a content-defined cut, so an
edit moves no cuts behind it). Equal roots mean equal texts; differing
branches lead to the edited segments. Two trees' likeness is the Jaccard
likeness of their leaves, weighed by bytes and counted with repeats: equal
branches count whole, and only differing ones are gone into. The fingerprint is
the root and a bounded sketch of the leaves, for comparing texts whose trees
are not at hand (likeness_of_prints; an estimate beyond SKETCH leaves).

Defined cases: a null text is the empty text; the row after the last is the
first; rows of equal doc_id are ordered by text, null doc_id comes first, and
rows of one doc_id are read by one task, as a stream; ids may be any long and
lie anyhow; a single row follows itself; texts of any length are taken whole;
an empty table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import partitions

SEGMENT = re.compile(rb"[^.!?\n]{0,32}[^.!?\s]*[.!?\s]*")
#: Leaves that a fingerprint keeps; texts with fewer keep all.
SKETCH = 128
#: A section ends after one paragraph in so many, on average.
SECTION = 8
#: Accuracy of the quantiles of doc_id that deal the documents out evenly.
ACCURACY = 20_000


def _digest(kind: bytes, parts: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(kind + parts, digest_size=size).digest()


class Tree(NamedTuple):
    root: bytes
    sections: list[tuple[bytes, int, int]]  # digest, its first paragraph, the paragraph after its last
    paragraphs: list[tuple[bytes, int, int]]  # digest, its first leaf, the leaf after its last
    leaves: list[bytes]
    ends: list[int]  # UTF-8 byte where each leaf ends


def merkle_tree(text: str) -> Tree:
    """The tree of a text's UTF-8 bytes, lines keep their line feed."""
    blake = hashlib.blake2b
    sections: list[tuple[bytes, int, int]] = []
    paragraphs: list[tuple[bytes, int, int]] = []
    leaves: list[bytes] = []
    ends: list[int] = []
    opened, end = 0, 0
    for line in text.encode("utf-8", "surrogatepass").splitlines(keepends=True) if text else ():
        first = len(leaves)
        for piece in SEGMENT.findall(line):
            if piece:
                leaves.append(blake(piece, digest_size=8).digest())
                end += len(piece)
                ends.append(end)
        node = _digest(b"p", b"".join(leaves[first:]))
        paragraphs.append((node, first, len(leaves)))
        if not line.strip() or node[0] % SECTION == 0:
            sections.append((_digest(b"s", b"".join(p[0] for p in paragraphs[opened:])), opened, len(paragraphs)))
            opened = len(paragraphs)
    if opened < len(paragraphs):
        sections.append((_digest(b"s", b"".join(p[0] for p in paragraphs[opened:])), opened, len(paragraphs)))
    return Tree(_digest(b"r", b"".join(s[0] for s in sections)), sections, paragraphs, leaves, ends)


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Byte spans of a whose segments b lacks, found by going down only into branches that b lacks."""
    if a.root == b.root:
        return []
    have_sections, have_paragraphs, have_leaves = {s[0] for s in b.sections}, {p[0] for p in b.paragraphs}, set(b.leaves)
    spans: list[tuple[int, int]] = []
    for digest, first, last in a.sections:
        if digest in have_sections:
            continue
        for node, i, j in a.paragraphs[first:last]:
            if node in have_paragraphs:
                continue
            for k in range(i, j):
                if a.leaves[k] not in have_leaves:
                    start = a.ends[k - 1] if k else 0
                    if spans and spans[-1][1] == start:
                        spans[-1] = (spans[-1][0], a.ends[k])
                    else:
                        spans.append((start, a.ends[k]))
    return spans


def fingerprint(tree: Tree) -> str:
    """The root in hex, a colon and the least SKETCH distinct leaf digests (their first 8 hex digits each)."""
    return tree.root.hex() + ":" + b"".join(sorted({leaf[:4] for leaf in tree.leaves})[:SKETCH]).hex()


def likeness_of_prints(a: str, b: str) -> float:
    """Likeness of two fingerprints' leaves by their sketches, 1 if and only if their roots are equal."""
    if a == b:
        return 1.0
    x, y = ([f[i : i + 8] for i in range(33, len(f), 8)] for f in (a, b))
    both = sorted({*x, *y})
    if len(x) >= SKETCH or len(y) >= SKETCH:
        both = both[:SKETCH]
    common = set(x) & set(y)
    shared = sum(1 for h in both if h in common)
    return shared / (len(both) + 1) if shared == len(both) else shared / len(both)


def unmatched(a: Tree, b: Tree) -> Counter:
    """Leaves of a, with their bytes and numbers, below branches that b has not as often."""
    out: Counter = Counter()
    sections, paragraphs = Counter(s[0] for s in b.sections), Counter()
    for digest, first, last in b.sections:
        paragraphs.update(p[0] for p in b.paragraphs[first:last])
    for digest, first, last in a.sections:
        if sections[digest] > 0:
            sections[digest] -= 1
            paragraphs.subtract(p[0] for p in a.paragraphs[first:last])
            continue
        for k in range(first, last):
            out[k] += 1
    rest: Counter = Counter()
    for k in out:
        node, i, j = a.paragraphs[k]
        if paragraphs[node] > 0:
            paragraphs[node] -= 1
            continue
        for leaf in range(i, j):
            rest[a.leaves[leaf], a.ends[leaf] - (a.ends[leaf - 1] if leaf else 0)] += 1
    return rest


def likeness(a: Tree, b: Tree) -> float:
    """Bytes of leaves in common over bytes of leaves in either, with repeats; 1 if and only if the roots are equal."""
    if a.root == b.root:
        return 1.0
    x, y = unmatched(a, b), unmatched(b, a)
    total = (a.ends[-1] if a.ends else 0) + (b.ends[-1] if b.ends else 0)
    lost = sum(n * size for (_, size), n in x.items()) + sum(n * size for (_, size), n in y.items())
    found = sum(min(n, y[key]) * key[1] for key, n in x.items() if key in y)
    common = (total - lost) / 2 + found
    share = common / (total - common) if total > common else 0.0
    return min(max(share, 0.0), 1 - 1e-9)


def edit_with_next(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many (or all) from the front of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def bucket_of(bounds: list[int]) -> F.Column:
    """How many of the sorted bounds are not above doc_id, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    known, n = F.lit(bounds), len(bounds)
    up = lambda at, step: F.when((at + step <= n) & (F.get(known, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at)
    return F.coalesce(F.aggregate(F.lit(steps), F.lit(0), up), F.lit(0))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text dealt by ranges of doc_id, each partition sorted and followed by the next one's first row (role 1).

    The driver holds one id for each partition.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [k / n for k in range(1, n)] or [1.0]
    quantiles = docs.agg(F.percentile_approx("doc_id", shares, ACCURACY)).first()[0]
    bucket = bucket_of(sorted(set(quantiles or ())))
    counted = docs.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    firsts = {r.bucket: None if r.nulls else r.first for r in counted}
    order = sorted(firsts)
    before = [(firsts[b], order[k - 1]) for k, b in enumerate(order)]  # the last bucket goes on with the first row
    heads = spark.createDataFrame(before, "head long, before int")
    placed = docs.withColumn("bucket", bucket).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("role"))
    again = F.struct(F.col("before").alias("to"), F.lit(1).alias("role"))
    dealt = placed.withColumn("go", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, again))))
    dealt = dealt.select("doc_id", "text", F.col("go.to").alias("to"), F.col("go.role").alias("role"))
    return dealt.repartitionById(n, "to").sortWithinPartitions("role", F.asc_nulls_first("doc_id"), "text").drop("to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, in doc_id order.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_leaves, edited_spans (byte ranges of the edited
    text that the original lacks).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, text, tree, fingerprint
        for batch in batches:
            rows = []
            for doc_id, text, role in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "role")), strict=True):
                if held is not None and held[4]:
                    break  # further rows of the next partition's first doc_id
                tree = merkle_tree(text)
                new = (doc_id, text, tree, fingerprint(tree), role)
                if held is not None:
                    rows.append(compare(held, new))
                held = new
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def compare(own: tuple, following: tuple) -> tuple:
        edited = edit_with_next(own[1], following[1])
        tree = merkle_tree(edited)
        mark = fingerprint(tree)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        spans = [{"start": i, "stop": j} for i, j in differing(tree, own[2])]
        return own[0], len(own[1]), sha, own[3], mark, likeness(own[2], tree), likeness(own[2], following[2]), len(own[2].leaves), spans

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_leaves", "edited_spans"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), span]
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_leaves long, edited_spans array<struct<start:long,stop:long>>"
    )
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return in_order(docs).mapInArrow(run, schema)
