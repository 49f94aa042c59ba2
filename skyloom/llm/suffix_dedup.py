"""Removal of repeated passages by an enhanced suffix array over matching regions.

A byte goes if a string of LENGTH bytes that covers it also starts earlier
(smaller doc_id, or earlier in the same document).

Runs: of the grams in each window of LENGTH bytes the least by hash is the
window's core, so equal windows have equal cores at equal offsets. Neighbouring
windows with one core are a run; its key is the core's hash and its context
the stretch of text under its windows. Equal windows always have equal keys, so
keys deal the corpus into groups without losing a match.

A key with too many different contexts (a common short line in ever different
surroundings) is refined: the core grows by half of what it lacks to a whole
window, to the right for the windows that reach so far, to the left for the
others, and the run falls into two with keys of their own. Again equal windows
take the same turn. Keys that are frequent in a sample are refined before
anything moves, what is still too large in its task; after the last step a
run is one window, and equal keys mean equal contexts. Where a key is refined
affects speed only.

Equal contexts: all but the earliest go. Of many runs a task sends on one of
them, so a passage that very many documents share is no large group either.
Different contexts of one key: their suffixes are sorted, with the lengths of
their common prefixes (the enhanced suffix array); a scan with a stack walks
the tree of common-prefix intervals and reports, for every interval of LENGTH
or more whose occurrences differ in the byte before them, the maximal repeat
with all its occurrences. All but the earliest are removed.

Defined cases: a null text is empty; texts shorter than LENGTH keep all; rows
without doc_id take no part and keep all; rows that repeat a doc_id are the
same document: equal texts are treated alike, and of different ones each loses
what was found in any of them; equal strings are ordered by doc_id and start,
so there are no ties; an empty table gives an empty result; extra columns of
any name are ignored. Keys and contexts are told apart by 64-bit hashes.
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
from skyloom.llm.common import map_arrow, map_batches, materialise, partitions, slices, unused, utf8

LENGTH = 100
#: Bytes of a core at first.
GRAM = 24
#: One document in so many is looked at for frequent keys, and different
#: contexts there that make a key frequent. They only affect speed.
SAMPLE, FREQUENT = 16, 32
FREQUENT_KEPT = 1_000_000
#: Runs, about, among which a task looks for equal contexts before it sends them on.
TOGETHER = 200_000
#: Different contexts of a key that a task compares without refining it; its suffixes take some 60 KB of memory each.
MOST_CONTEXTS = 500
#: Bytes of texts that a task looks at together: index arrays take a hundred times as many.
PART_BYTES = 1 << 18
#: Told apart from a core that grew to the right.
GREW_LEFT = np.uint64(0x3C6EF372FE94F82B)


class Runs(NamedTuple):
    """Runs of windows in the bytes of many texts; all positions count from the first byte of the first text."""

    key: np.ndarray
    core: np.ndarray
    first: np.ndarray  # window
    last: np.ndarray
    doc: np.ndarray  # index of its text

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in self))


def joined(parts: list[Runs]) -> Runs:
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def widths(length: int, gram: int) -> list[int]:
    """Bytes of a core before and after each refinement, up to a whole window."""
    out = [gram]
    while out[-1] < length:
        out.append(out[-1] + (length - out[-1] + 1) // 2)
    return out


def first_runs(raw: np.ndarray, offsets: np.ndarray, roll: words.Rolling, length: int, gram: int) -> Runs:
    """The runs of each text by its windows' least grams."""
    z = np.zeros(0, np.int64)
    none = Runs(z.astype(np.uint64), z, z, z, z)
    n = len(raw) - length + 1
    if n < 1:
        return none
    start = np.arange(len(raw) - gram + 1)
    h = roll.of(start, start + gram)
    value = (h & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    w = length - gram + 1
    blocks = -(-len(value) // w)
    padded = np.full(blocks * w, np.uint64(2**64 - 1))
    padded[: len(value)] = value
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie in one text
    sizes = np.diff(offsets)
    per = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), per)
    if not len(doc):
        return none
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + offsets[:-1][doc]
    core = least[at]
    first = np.flatnonzero(np.concatenate([[True], (core[1:] != core[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    return Runs(h[core[first]], core[first], at[first], at[last], doc[first])


def refined(runs: Runs, roll: words.Rolling, width: int, wider: int, length: int) -> Runs:
    """The runs with cores of the next width."""
    grow = wider - width
    turn = runs.core + wider - length  # windows from here on hold the bytes right of the core
    right = runs._replace(first=np.maximum(runs.first, turn))
    right = right.take(right.first <= right.last)
    right = right._replace(key=roll.of(right.core, right.core + wider))
    left = runs._replace(core=runs.core - grow, last=np.minimum(runs.last, turn - 1))
    left = left.take(left.first <= left.last)
    return joined([right, left._replace(key=roll.of(left.core, left.core + wider) ^ GREW_LEFT)])


def placed(raw: np.ndarray, offsets: np.ndarray, frequent: list[np.ndarray], length: int, gram: int) -> tuple[list[Runs], words.Rolling]:
    """The runs of all texts by level; the last list entry has those that no frequent key refines."""
    roll, sizes = words.Rolling(raw), widths(length, gram)
    runs, out = first_runs(raw, offsets, roll, length, gram), []
    for level, keys in enumerate(frequent):
        hot = np.isin(runs.key, keys)
        out.append(runs.take(~hot))
        runs = refined(runs.take(hot), roll, sizes[level], sizes[level + 1], length)
    return [*out, runs], roll


def frequent_keys(docs: DataFrame, length: int, gram: int) -> list[np.ndarray]:
    """For each level the sorted keys with many different contexts in a sample; bounded by FREQUENT_KEPT."""
    found: list[np.ndarray] = []
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part in slices(batch, "text", PART_BYTES):
            levels, roll = placed(*utf8(part.column("text")), found, length, gram)
            runs = levels[-1]
            out.append(np.stack([runs.key, roll.of(runs.first, runs.last + length)]).view(np.int64))
        key, mark = np.concatenate(out, 1)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(mark)], ["key", "mark"])

    for _ in range(len(widths(length, gram)) - 1):
        counted = map_arrow(sample, one, "key long, mark long").distinct().groupBy("key").count().filter(F.col("count") >= FREQUENT)
        keys = counted.orderBy(F.desc("count"), "key").limit(FREQUENT_KEPT).select("key").toArrow().column("key").to_numpy()
        if not len(keys):
            break
        found.append(np.sort(keys.view(np.uint64)))
    return found


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents as maximal runs, in order."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # each document's spans lie behind those of the one before
    base = (np.cumsum(new_doc) - 1) * (np.int64(1) << 40)
    reach = np.maximum.accumulate(base + stop)
    first = np.flatnonzero(np.concatenate([[True], base[1:] + start[1:] > reach[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - base[last]


OCCURRENCE = "key long, mark long, doc_id long, start int, stop int, core int, level int"


def occurrences(docs: DataFrame, frequent: list[np.ndarray], length: int, gram: int) -> DataFrame:
    """The earliest occurrence of each context among TOGETHER runs, and spans (without mark) of its later ones there."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        held = 0
        for part in (part for batch in batches for part in slices(batch, "text", PART_BYTES)):
            raw, offsets = utf8(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            levels, roll = placed(raw, offsets, shared.value, length, gram)
            for level, runs in enumerate(levels):
                base = offsets[:-1][runs.doc]
                mark = roll.of(runs.first, runs.last + length)
                for col, x in zip(cols, (runs.key, mark, ids[runs.doc], runs.first - base, runs.last - base + length, runs.core - runs.first, np.full(len(base), level)), strict=True):
                    col.append(x)
                held += len(base)
            if held >= TOGETHER:
                yield earliest(cols)
                cols, held = [[] for _ in range(7)], 0
        if held:
            yield earliest(cols)

    def earliest(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, mark, doc, start, stop, core, level = (np.concatenate(c) for c in cols)
        order = np.lexsort((start, doc, mark, key))
        key, mark, doc, start, stop, core, level = (x[order] for x in (key, mark, doc, start, stop, core, level))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        later = (doc != doc[head]) | (start != start[head])
        d, s, e = merged(doc[later], start[later], stop[later])
        rest = len(d)  # spans have no mark, and their document deals them
        out = [key[new].view(np.int64), mark[new].view(np.int64), doc[new], start[new], stop[new], core[new], level[new]]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        more = [d, None, d, s, e, None, None]
        arrays = [pa.concat_arrays([pa.array(x, t), pa.nulls(rest, t) if y is None else pa.array(y, t)]) for x, y, t in zip(out, more, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in OCCURRENCE.split(", ")])

    return map_batches(docs, run, OCCURRENCE)


def later_and_shared(rows: DataFrame) -> DataFrame:
    """Spans (without key) of contexts that stand earlier too, and the earliest of each context whose key has others.

    Spans that are known already (rows without mark) pass through.
    """
    names = [c.split()[0] for c in OCCURRENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, mark, doc_id and start of the open context
        held: pa.RecordBatch | None = None  # the open key's only context so far
        sent = None  # the open key, once its contexts go out
        for batch in batches:
            known = batch.column("mark").is_null()
            spans = batch.filter(known).select(["doc_id", "start", "stop"])
            if spans.num_rows:
                none = [pa.nulls(spans.num_rows, t) for t in (pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([none[0], none[0], *spans.columns, none[1], none[1]], names)
            batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            key, mark, doc, start, stop = (batch.column(c).to_numpy(zero_copy_only=False) for c in names[:5])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
            if last is not None and last[:2] == (key[0], mark[0]):
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            head_doc = np.where(at >= 0, doc[at], last[2] if last else 0)
            head_start = np.where(at >= 0, start[at], last[3] if last else 0)
            later = (doc != head_doc) | (start != head_start)
            last = (key[-1], mark[-1], head_doc[-1], head_start[-1])
            spans = merged(doc[later], start[later], stop[later])
            out = [pa.RecordBatch.from_arrays([pa.nulls(len(spans[0]), pa.int64())] * 2 + [pa.array(x, t) for x, t in zip(spans, (pa.int64(), pa.int32(), pa.int32()), strict=True)] + [pa.nulls(len(spans[0]), pa.int32())] * 2, names)]
            fresh = pa.RecordBatch.from_arrays(batch.filter(pa.array(new)).columns, names)
            if held is not None:
                fresh = pa.Table.from_batches([held, fresh]).combine_chunks().to_batches()[0]
            if fresh.num_rows:
                k = fresh.column("key").to_numpy(zero_copy_only=False)
                same = k[1:] == k[:-1]
                keep = np.zeros(len(k), bool)
                keep[1:] |= same
                keep[:-1] |= same
                if sent is not None:
                    keep |= k == sent
                held, sent = (None, k[-1]) if keep[-1] else (fresh.slice(len(k) - 1), None)
                out.append(fresh.filter(pa.array(keep)))
            yield from (x for x in out if x.num_rows)

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "mark", "doc_id", "start")
    return map_batches(dealt, run, OCCURRENCE)


def context_rows(texts: DataFrame) -> DataFrame:
    """(key, level, core, doc_id, start, context) of the listed places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                lists = part.column("places")
                place = lists.flatten()
                of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                raw, offsets = utf8(part.column("text"))
                begin, stop = (place.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
                # rows that repeat a doc_id may have other, shorter texts
                inside = stop <= np.diff(offsets)[of]
                place, of, begin, stop = place.filter(pa.array(inside)), of[inside], begin[inside], stop[inside]
                size = (stop - begin).astype(np.int64)
                ends = np.cumsum(size)
                where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[of] + begin - (ends - size), size)
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                contexts = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[where]))])
                cols = [place.field("key"), place.field("level"), place.field("core"), part.column("doc_id").take(pa.array(of)), place.field("start"), contexts]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, kinds, strict=True)], ["key", "level", "core", "doc_id", "start", "context"])

    return map_batches(texts, run, "key long, level int, core int, doc_id long, start int, context binary")


class SuffixArray:
    """Sorted suffixes of LENGTH bytes or more of short strings, with common prefix lengths."""

    def __init__(self, contexts: list[bytes], length: int):
        sizes = np.array([len(c) for c in contexts], np.int64)
        per = np.maximum(sizes - length + 1, 0)
        self.context = np.repeat(np.arange(len(contexts)), per)
        self.offset = np.arange(len(self.context)) - np.repeat(np.cumsum(per) - per, per)
        width = int(sizes.max())
        flat = np.frombuffer(b"".join(contexts) + bytes(width), np.uint8)
        rest = sizes[self.context] - self.offset
        # a shorter suffix stands before its extensions, also before those by NUL bytes, which the comparison ignores at the end
        shorter = np.argsort(rest, kind="stable")
        self.context, self.offset, rest = self.context[shorter], self.offset[shorter], rest[shorter]
        at = (np.cumsum(sizes) - sizes)[self.context] + self.offset
        grid = np.lib.stride_tricks.sliding_window_view(flat, width)[at] if len(at) else np.zeros((0, width), np.uint8)
        grid[np.arange(width)[None] >= rest[:, None]] = 0
        order = np.argsort(grid.view(f"S{width}").ravel(), kind="stable")
        self.order = order
        grid, rest = grid[order], rest[order]
        differ = grid[1:] != grid[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width) if len(order) > 1 else np.zeros(0, np.int64)
        self.common = np.minimum(common, np.minimum(rest[1:], rest[:-1]))
        before = flat[np.maximum(at - 1, 0)].astype(np.int64)
        # the start of a context is unlike any byte: what stands before it is not known
        self.before = np.where(self.offset == 0, -1 - np.arange(len(at)), before)[order]

    def maximal_repeats(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(common length, first, last + 1) of each left-diverse interval of sorted suffixes.

        The stack holds the open intervals: common length, first suffix, and
        the one byte before all its suffixes or None if they differ. Stretches
        of suffixes that share no LENGTH bytes hold no interval and are not
        walked.
        """
        deep = np.concatenate([[False], self.common >= length, [False]])
        edges = np.flatnonzero(deep[1:] != deep[:-1])
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            # suffixes low to high, with common prefixes self.common[low:high]
            common, before = [*self.common[low:high].tolist(), 0], self.before[low : high + 1].tolist()
            stack: list[tuple[int, int, int | None]] = []
            for i, here in enumerate(common):
                first, left = i, before[i]
                while stack and stack[-1][0] > here:
                    size, first, seen = stack.pop()
                    left = seen if seen == left else None
                    if left is None:
                        yield size, low + first, low + i + 1
                if here >= length:
                    if stack and stack[-1][0] == here:
                        size, begin, seen = stack[-1]
                        stack[-1] = (size, begin, seen if seen == left else None)
                    else:
                        stack.append((here, first, left))


Spans = tuple[np.ndarray, np.ndarray, np.ndarray]
Context = tuple[bytes, int, int, int]  # bytes, doc_id, start in the text, core from its start


def removed_spans(contexts: list[Context], length: int) -> Spans:
    """doc_id, start and stop of what different contexts lose to earlier occurrences."""
    sa = SuffixArray([c[0] for c in contexts], length)
    doc = np.array([c[1] for c in contexts], np.int64)[sa.context[sa.order]]
    start = np.array([c[2] for c in contexts], np.int64)[sa.context[sa.order]] + sa.offset[sa.order]
    found: list[Spans] = [(np.zeros(0, np.int64),) * 3]
    for size, first, last in sa.maximal_repeats(length):
        d, s = doc[first:last], start[first:last]
        own = np.flatnonzero(d == d.min())
        earliest = own[s[own].argmin()]
        later = (d != d[earliest]) | (s != s[earliest])
        found.append((d[later], s[later], s[later] + size))
    return merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def refined_groups(contexts: list[Context], level: int, length: int, gram: int) -> tuple[list[tuple[int, list[Context]]], Spans]:
    """A key's contexts dealt by the next level's keys, different ones only, and the spans of equal ones."""
    sizes = widths(length, gram)
    raw = np.frombuffer(b"".join(c[0] for c in contexts), np.uint8)
    n = np.array([len(c[0]) for c in contexts], np.int64)
    base = np.cumsum(n) - n
    core = base + np.array([c[3] for c in contexts], np.int64)
    roll = words.Rolling(raw)
    runs = refined(Runs(np.zeros(len(n), np.uint64), core, base, base + n - length, np.arange(len(n))), roll, sizes[level], sizes[level + 1], length)
    doc, begin = (np.array([c[k] for c in contexts], np.int64)[runs.doc] for k in (1, 2))
    begin = begin + runs.first - base[runs.doc]
    mark = roll.of(runs.first, runs.last + length)
    order = np.lexsort((begin, doc, mark, runs.key))
    runs, doc, begin, mark = runs.take(order), doc[order], begin[order], mark[order]
    new = np.ones(len(mark), bool)
    new[1:] = (runs.key[1:] != runs.key[:-1]) | (mark[1:] != mark[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(mark)), 0))
    later = (doc != doc[head]) | (begin != begin[head])
    spans = merged(doc[later], begin[later], (begin + runs.last - runs.first + length)[later])
    key = runs.key[new]
    kept = runs.take(new)
    whole = raw.tobytes()
    own = [(whole[i : j + length], d, s, c - i) for i, j, d, s, c in zip(*(x.tolist() for x in (kept.first, kept.last, doc[new], begin[new], kept.core)), strict=True)]
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(own)]
    return [(level + 1, own[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], spans


def compare_contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Removed spans (doc_id, start, stop) of different contexts with one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Spans] = []
        pending: list[Context] = []  # of keys that are complete
        own: list[Context] = []  # of the key that is open
        opened = None

        def compare_pending() -> None:
            nonlocal pending
            if pending:
                found.append(removed_spans(pending, length))
            pending = []

        def close() -> None:
            nonlocal own, pending
            todo = [(opened[1], own)] if own else []
            own = []
            while todo:
                level, group = todo.pop()
                if len(group) > MOST_CONTEXTS and level + 1 < len(widths(length, gram)):
                    parts, spans = refined_groups(group, level, length, gram)
                    found.append(spans)
                    todo += parts
                else:
                    pending += group
                    if len(pending) > MOST_CONTEXTS:
                        compare_pending()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found
            if found:
                spans = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(spans, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "start", "stop"])
            found = []

        for batch in batches:
            for key, level, core, doc, start, context in zip(*(batch.column(k).to_pylist() for k in ("key", "level", "core", "doc_id", "start", "context")), strict=True):
                if (key, level) != opened:
                    close()
                    opened = key, level
                own.append((context, doc, start, core))
            yield from flush()
        close()
        compare_pending()
        yield from flush()

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "level", "doc_id", "start")
    return map_batches(dealt, run, "doc_id long, start int, stop int")


def removed_lists(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """id and found, the removed spans (overlapping, unordered), of each doc_id that loses something."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = materialise(later_and_shared(occurrences(docs, frequent_keys(docs, length, gram), length, gram)), "spans")
    places = found.filter(F.col("key").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("key", "level", "core", "start", "stop")).alias("places"))
    compared = compare_contexts(context_rows(docs.join(places, "doc_id")), length, gram)
    spans = found.filter(F.col("key").isNull()).select("doc_id", "start", "stop")
    return spans.union(compared).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))


def cut_out(raw: bytes, spans: list[dict] | None) -> tuple[bytes, list[dict]]:
    """The bytes outside the spans, and the spans as maximal runs."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], min(s["stop"], len(raw))) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        elif start < stop:
            out.append([start, stop])
    edges = [0, *(x for s in out for x in s), len(raw)]
    return b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)), [{"start": i, "stop": j} for i, j in out]


def with_found(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, str]:
    """docs with the removed spans of each row in one more column, and that column's name."""
    name = unused(docs, "found")
    rows = docs.select(F.struct("*").alias("row")).join(removed_lists(docs, length, gram), F.col("row.doc_id").cast("long") == F.col("id"), "left")
    return rows.select("row.*", F.col("found").alias(name)), name


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct<start,stop>> (maximal removed runs) and kept (bytes) of each row.

    Cases are as in the module's docstring; repeated rows give a row each.
    """
    rows, _ = with_found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "found")), strict=True):
                    raw = (text or "").encode()
                    kept, spans = cut_out(raw, found)
                    out.append((doc_id, len(raw), len(raw) - len(kept), spans, kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return map_batches(rows, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs, all rows and columns, with the repeated passages taken out of text, and n_chars counted anew.

    A character that lost only some of its bytes goes with them; a null text
    becomes empty; other cases are as in the module's docstring.
    """
    names = docs.columns
    rows, found_name = with_found(docs, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [cut_out((t or "").encode(), f)[0].decode("utf-8", "ignore") for t, f in zip(part.column("text").to_pylist(), part.column(found_name).to_pylist(), strict=True)]
                cols = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(cols, names)

    cut = map_batches(rows, run, docs.schema)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut
