"""Benchmark decontamination: windows of benchmark items that stand in documents, by a prefix-filtered join.

An item's windows are its stretches of WINDOW words (an item of fewer words is
one window). A window stands in a document if all its words do, in place, so
any one of its shingles (GRAM words, or the whole of a shorter window) is a
prefix that the document must hold: the rarest one, by a count of the items'
shingles over all documents. One that stands in no document drops its window.

Documents are read twice. The first pass counts the items' shingles in them;
counts are added up in each task before they move. The second finds the places
of the windows' rarest shingles, each with the hashes of the words around it,
as far as a window reaches. Places and windows are joined on the shingle. A
window fits at a place if the text has as many words before and after as the
window needs, and is there if the words around it are the window's.

To pass over shingles that no item has, tasks get a map of bits of the items'
hashed shingles, of at most 2 ** MAP_BITS bits whatever the number of items; a
wrong bit costs a row that the join drops. Shingles that are frequent in the
documents (a passage in a third of them) are dealt out by salt: their places to
as many parts as their count asks for, their windows to each part.

Documents that hold the same windows share one list of items, found once for
each set of windows.

Defined cases: a null or empty text has no words; an item without words, or
without item_id, takes no part; rows that repeat an item_id are one item with
the windows of all of them; rows that repeat a doc_id, and rows without one,
are judged each on their own; texts are read whole; overlapping windows hit a
word once; with an empty benchmark no document is hit; an empty table of
documents gives an empty result; extra columns of any name are ignored. Words
and windows are told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import words
from skyloom.llm.common import map_arrow, materialise, slices, utf8

WINDOW = 10
GRAM = 3
#: Bits of the map of hashed shingles, at most, and bits for each shingle.
MAP_BITS = 27
BITS_A_SHINGLE = 64
#: Places of a shingle in the documents for each part that it is dealt to.
PLACES_A_PART = 2_000
#: Places that a task sends on at a time.
PLACES_HELD = 20_000
#: Shingles whose salt is sent to tasks, the most frequent ones first.
SALTED = 100_000


def grams(word: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next `size` words stand in one text, and their hashes. left: words from each place to the end of its text."""
    at = np.flatnonzero(left >= size)
    total = np.full(len(at), size, np.uint64)
    for k in range(size):
        total += word[at + k] * words.SHIFT[k]
    return at, words.mix(total)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, the number of words of each text, and the words from each place to its text's end."""
    raw, offsets = utf8(texts)
    w = words.split(raw, offsets, words.TERM)
    word = words.hashes(raw, w.start, w.end)
    return word, w.count, np.repeat(np.cumsum(w.count), w.count) - np.arange(len(word))


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item_id, words, size (of a shingle) and shingles of each window of each item."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found, sizes, shingles = [], [], [], []
        for part in slices(batch, "text"):
            word, count, left = text_words(part.column("text"))
            start = np.cumsum(count) - count
            known = part.column("item_id").to_pylist()
            for k in np.flatnonzero(count).tolist():
                length = min(window, int(count[k]))
                size = min(gram, length)
                own = word[start[k] : start[k] + count[k]]
                _, of = grams(own, np.arange(len(own), 0, -1), size)
                for i in range(len(own) - length + 1):
                    ids.append(known[k])
                    found.append(own[i : i + length].view(np.int64))
                    sizes.append(size)
                    shingles.append(of[i : i + length - size + 1].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], ["item_id", "words", "size", "shingles"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    return map_arrow(rows, one, "item_id string, words array<long>, size int, shingles array<long>")


class Bits:
    """A map of bits of hashes."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.shift, self.cells = np.uint64(64 - bits), cells

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.shift
        return (self.cells[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def bit_map(shingles: DataFrame) -> Bits:
    """The map of the column shingle: its bits are put together in Spark, 64 a row, and bounded by MAP_BITS."""
    n = shingles.count()
    bits = int(min(MAP_BITS, max(10, np.ceil(np.log2(max(1, n) * BITS_A_SHINGLE)))))
    rows = shingles.select(F.shiftrightunsigned("shingle", 64 - bits + 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - bits}) & 63 AS int))").alias("bit"))
    table = rows.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    cells = np.zeros(1 << (bits - 6), np.uint64)
    cells[table.column("cell").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Bits(bits, cells)


def counted(docs: DataFrame, bits: Bits, sizes: list[int]) -> DataFrame:
    """shingle and n, its number of places in all documents, of the shingles in the map."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for part in slices(batch, "text"):
            word, _, left = text_words(part.column("text"))
            for size in sizes:
                h = grams(word, left, size)[1]
                found.append(h[shared.value.has(h)])
        shingle, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    return map_arrow(docs.select("text"), one, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """words, size, shingle and before (words of the window before it) of each window whose shingles all stand in documents."""
    each = windows.select("words", "size", F.posexplode("shingles").alias("before", "shingle"))
    known = each.join(counts, "shingle", "left")
    best = known.groupBy("words", "size").agg(F.min_by(F.struct("shingle", "before", F.coalesce("n", F.lit(0)).alias("n")), F.struct(F.coalesce("n", F.lit(0)), "shingle", "before")).alias("b"))
    return best.select("words", "size", F.xxhash64("words").alias("window"), "b.*").filter("n > 0")


PLACES = "doc_id long, mark long, n_words long, shingle long, salt int, at int, left int, around array<long>"


def places(docs: DataFrame, bits: Bits, sizes: list[int], parts: tuple[np.ndarray, np.ndarray], window: int) -> DataFrame:
    """A row for each document, with n_words, and one for each place of the map's shingles, with the words around it.

    mark tells whole rows apart; at is the shingle's first word, and left the
    number of words of around before it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bits, parts))
    names = [c.split()[0] for c in PLACES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (salted, n_parts) = shared.value
        for part in (part for batch in batches for part in slices(batch, "text")):
            word, count, left = text_words(part.column("text"))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(count, pa.int64()), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int32()) for _ in range(3)), pa.nulls(n, pa.list_(pa.int64()))], names)
            at, h = (np.concatenate(x) for x in zip(*((at[hit], h[hit]) for at, h in (grams(word, left, size) for size in sizes) for hit in (m.has(h),)), strict=True))
            ends = np.cumsum(count)
            mark = part.column("mark").to_numpy()
            for some in np.split(np.arange(len(at)), range(PLACES_HELD, len(at), PLACES_HELD)):
                where, key = at[some], h[some].view(np.int64)
                doc = np.searchsorted(ends, where, side="right")
                begin = (ends - count)[doc]
                first, last = np.maximum(where - window + 1, begin), np.minimum(where + window, ends[doc])
                cut = np.concatenate([[0], np.cumsum(last - first)])
                around = word[np.arange(cut[-1]) + np.repeat(first - cut[:-1], last - first)].view(np.int64)
                spread = np.ones(len(key), np.uint64)
                if len(salted):
                    k = np.minimum(np.searchsorted(salted, key), len(salted) - 1)
                    spread = np.where(salted[k] == key, n_parts[k], 1).astype(np.uint64)
                salt = words.mix(mark[doc].view(np.uint64) + (where - begin).astype(np.uint64)) % spread
                numbers = [pa.array(x.astype(np.int32)) for x in (salt, where - begin, where - first)]
                of = pa.array(doc)
                cols = [part.column("doc_id").take(of), part.column("mark").take(of), pa.nulls(len(doc), pa.int64()), pa.array(key), *numbers, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(around))]
                if len(doc):
                    yield pa.RecordBatch.from_arrays(cols, names)

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("mark"), "text")
    return marked.mapInArrow(run, PLACES)


def salts(windows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles with more places than a part takes, and their numbers of parts; the SALTED most frequent ones."""
    rows = windows.groupBy("shingle").agg(F.max("n").alias("n")).filter(F.col("n") > PLACES_A_PART).orderBy(F.desc("n"), "shingle").limit(SALTED).toArrow().sort_by("shingle")
    return rows.column("shingle").to_numpy(), -(-rows.column("n").to_numpy() // PLACES_A_PART)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, mark, n_words), (hits: mark, doc_id, window, start, length), (items: window, item_id)."""
    every = materialise(item_windows(items, window, gram), "windows")
    windows = every.dropDuplicates(["words"]).select("words", "size", "shingles")
    sizes = sorted(r.size for r in every.select("size").distinct().collect())  # at most gram numbers
    if not sizes:
        sizes = [gram]
    shingles = windows.select(F.explode("shingles").alias("shingle")).distinct()
    counts = counted(docs, bit_map(shingles), sizes).join(shingles, "shingle", "left_semi")
    chosen = materialise(rarest(windows, counts), "rarest")
    parts = salts(chosen)
    found = materialise(places(docs, bit_map(chosen.select("shingle").distinct()), sizes, parts, window), "places")

    n_parts = F.lit(1)
    if len(parts[0]):
        spread = docs.sparkSession.createDataFrame(pa.table({"of": parts[0], "parts": parts[1]}))
        chosen = chosen.join(F.broadcast(spread), F.col("shingle") == F.col("of"), "left")
        n_parts = F.coalesce("parts", F.lit(1)).cast("int")
    dealt = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), n_parts - 1))).select("shingle", "salt", "words", "window", "before")
    at = found.filter("n_words IS NULL").drop("n_words")
    fits = (F.col("before") <= F.col("left")) & (F.col("left") - F.col("before") + F.size("words") <= F.size("around"))
    same = F.slice("around", F.col("left") - F.col("before") + 1, F.size("words")) == F.col("words")
    there = at.join(dealt, ["shingle", "salt"]).filter(F.when(fits, same).otherwise(F.lit(False)))
    hit = there.select("doc_id", "mark", "window", (F.col("at") - F.col("before")).alias("start"), F.size("words").alias("length"))
    return found.filter("n_words IS NOT NULL").select("doc_id", "mark", "n_words"), hit, every.select(F.xxhash64("words").alias("window"), "item_id").distinct()


def covered(spans: F.Column) -> F.Column:
    """Words in the union of sorted spans (start, length)."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))

    def add(s: F.Column, x: F.Column) -> F.Column:
        end = (x["start"] + x["length"]).cast("long")
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(s["reach"], x["start"].cast("long")))
        return F.struct((s["total"] + new).alias("total"), F.greatest(s["reach"], end).alias("reach"))

    return F.aggregate(spans, zero, add, lambda s: s["total"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs, and items, the item_ids found.

    items are sorted as strings; items_sha256 is of these, joined by commas.
    """
    rows, hit, of_item = hits(docs, items, window, gram)
    by_doc = hit.groupBy("mark", "doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("window")).alias("windows"))
    by_doc = materialise(by_doc.select("mark", F.col("doc_id").alias("of"), covered(F.col("spans")).alias("n_hit"), F.xxhash64("windows").alias("set"), "windows"), "hits")
    sets = by_doc.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
    lists = sets.join(of_item, "window").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    listed = by_doc.join(lists, "set").select(F.col("mark").alias("of_mark"), "of", "n_hit", "items")
    out = rows.join(listed, (F.col("mark") == F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    none = F.array().cast("array<string>")
    n_hit, found = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", none)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), found.alias("items"))
