"""Periodic runs of words: every maximal repetition in a text, found by counting matches lag by lag.

A run is a stretch of consecutive words with smallest period q, at least
``max(LEAST, 2 * q)`` words long, that no neighbouring word extends with the
same period. In it each word but the last q equals the one q places on, so a
text can only have a run of period q if at lag q at least ``max(q, LEAST - q)``
words match. The numbers of matches at all lags up to half a text come from two
sides, word by word: a rare word gives the differences of the pairs of its
places, all texts of a slice at once; a frequent one, for which there would be
too many pairs, gives the autocorrelation of its places by a fast Fourier
transform, rounded to whole numbers (the error is far below a half).

Only lags with enough matches are scanned for islands of matching words, in
rising order. An island gives a run of that lag's period, unless the same
stretch is known with a smaller one. Matches inside a run at the multiples of
its period are then taken off: at such a lag they form an island of their own,
which is that run again. So a text of one repeated word is scanned once, not at
every lag. Scans look at every few words first: an island that is long enough
holds eight places in a row of a grid of an eighth of its least length.

Defined cases: a null or empty text has no words and no runs, and its collapsed
text is empty; texts are read whole, and a slice of texts is bounded in bytes
(a longer text is a slice of its own); rows that repeat a doc_id, and rows
without one, are read each on its own; of runs of equal length the first in
place, then the one of smaller period counts as the longest; an empty table
gives an empty result; extra columns of any name are ignored. Words are told
apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import words
from skyloom.llm.common import slices, utf8

#: Words of the shortest run.
LEAST = 12
#: Pair differences that are held at a time.
PAIRS_HELD = 1 << 20
#: Places of a grid that a scan wants in a row.
GRID = 8

Run = tuple[int, int, int]  # start, length, period
#: Given the doc_ids and numbers of words of some texts: for each word of all texts, in order, the word that is read in its place.
Reading = Callable[[list, np.ndarray], np.ndarray]

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def places_by_word(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ordered by text and word, and for each of these its number in, and the size of, its word's group."""
    order = np.lexsort((word, doc))
    w, d = word[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]))
    size = np.diff(np.append(first, len(order)))
    return order, np.arange(len(order)) - np.repeat(first, size), np.repeat(size, size)


def lag_counts(word: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches at each lag from 0 (not counted) to half of each text, one text behind the other, and where each text's begin."""
    half = count // 2
    base = np.concatenate([[0], np.cumsum(half + 1)])
    total = np.zeros(base[-1], np.int64)
    if not len(word):
        return total, base
    start = np.cumsum(count) - count
    order, number, size = places_by_word(word, doc)
    # what a transform over a text costs, in pairs
    width = 1 << np.ceil(np.log2(np.maximum(2, count + half + 1))).astype(np.int64)
    heavy = size.astype(float) ** 2 > (width * np.log2(width))[doc[order]]
    at, of = order - start[doc[order]], doc[order]

    held: list[np.ndarray] = []
    n_held, step = 0, 0
    left = np.flatnonzero(~heavy & (size > 1))
    while len(left):
        step += 1
        left = left[number[left] + step < size[left]]
        gap = at[left + step] - at[left]
        near = gap <= half[of[left]]  # gaps only grow with the step
        left, gap = left[near], gap[near]
        held.append(base[of[left]] + gap)
        n_held += len(gap)
        if n_held >= PAIRS_HELD:
            total += np.bincount(np.concatenate(held), minlength=len(total))
            held, n_held = [], 0
    if n_held:
        total += np.bincount(np.concatenate(held), minlength=len(total))

    rows = np.flatnonzero(heavy)
    for places in np.split(rows, np.flatnonzero(of[rows][1:] != of[rows][:-1]) + 1) if len(rows) else ():
        k = of[places[0]]
        power = np.zeros(width[k] // 2 + 1)
        for group in np.split(places, np.flatnonzero(number[places] == 0)[1:]):
            there = np.zeros(width[k])
            there[at[group]] = 1
            seen = np.fft.rfft(there)
            power += seen.real**2 + seen.imag**2
        total[base[k] : base[k + 1]] += np.rint(np.fft.irfft(power, width[k])[: half[k] + 1]).astype(np.int64)
    return total, base


def streaks(ok: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each stretch of at least so many true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    first, last = edges[::2], edges[1::2]
    long_ = last - first >= least
    return first[long_], last[long_]


def islands(word: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """First and last + 1 of each maximal stretch of at least so many places whose word comes again at the lag."""
    n, grid = len(word) - lag, least // GRID
    if grid < 2:
        return list(zip(*(x.tolist() for x in streaks(word[:n] == word[lag:], least)), strict=True))
    out = []
    for i, j in zip(*(x.tolist() for x in streaks(word[:n:grid] == word[lag::grid], GRID)), strict=True):
        low, high = max(0, (i - 1) * grid + 1), min(n, j * grid)
        out += [(low + a, low + b) for a, b in zip(*(x.tolist() for x in streaks(word[low:high] == word[low + lag : high + lag], least)), strict=True)]
    return out


def runs_of(word: np.ndarray, matches: np.ndarray, need: np.ndarray) -> list[Run]:
    """The runs of one text, by start and period. matches: of each lag up to half of the text, used up; need: the least for each lag."""
    found: dict[tuple[int, int], int] = {}
    for lag in (np.flatnonzero(matches[1:] >= need[1 : len(matches)]) + 1).tolist():
        if matches[lag] < need[lag]:
            continue
        for start, stop in islands(word, lag, int(need[lag])):
            end = stop + lag
            if (start, end) in found:
                continue
            found[start, end] = lag
            multiples = np.arange(2 * lag, min(end - start, len(matches)), lag)
            matches[multiples] -= end - start - multiples
    return sorted((start, end - start, lag) for (start, end), lag in found.items())


def runs_of_texts(word: np.ndarray, doc: np.ndarray, count: np.ndarray, least: int = LEAST) -> list[list[Run]]:
    """The runs of each text; word holds the hashes of all words, text by text."""
    matches, base = lag_counts(word, doc, count)
    lag = np.arange(int(count.max(initial=0)) // 2 + 1)
    need = np.maximum(lag, least - lag)
    own = np.repeat(np.arange(len(count)), np.diff(base))
    out: list[list[Run]] = [[] for _ in count]
    within = np.arange(len(matches)) - base[own]
    enough = np.bincount(own[(matches >= need[within]) & (within > 0)], minlength=len(count)) > 0
    start = np.cumsum(count) - count
    for k in np.flatnonzero(enough & (count >= least)).tolist():
        out[k] = runs_of(word[start[k] : start[k] + count[k]], matches[base[k] : base[k + 1]], need)
    return out


def joined_words(raw: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """n texts of the given words, with a space between any two."""
    size = last - first + 1  # and the space behind
    final = np.ones(len(doc), bool)
    final[:-1] = doc[1:] != doc[:-1]
    size = size - final
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    out = raw[np.minimum(where, max(0, len(raw) - 1))] if len(where) else np.zeros(0, np.uint8)
    out[ends[~final] - 1] = 0x20
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, size, n).astype(np.int64))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(out))])


def periodic_runs(docs: DataFrame, least: int = LEAST, reading: Reading | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of each row.

    collapsed has the words that are left, with a space between, when each run
    keeps its first period only: a word goes if any run holds it behind that.
    reading lets words be read otherwise than they stand, see planted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = utf8(part.column("text"))
                w = words.split(raw, offsets, ~words.SPACES)
                first, last = w.start, w.end
                if reading is not None:
                    read = reading(part.column("doc_id").to_pylist(), w.count)
                    first, last = first[read], last[read]
                found = runs_of_texts(words.hashes(raw, first, last, lower=False), w.doc, w.count, least)
                start = np.cumsum(w.count) - w.count
                gone = np.zeros(len(w.doc) + 1, np.int64)
                for k in (k for k, x in enumerate(found) if x):
                    begin, length, period = np.array(found[k]).T + np.array([[start[k]], [0], [0]])
                    np.add.at(gone, begin + period, 1)
                    np.add.at(gone, begin + length, -1)
                kept = np.cumsum(gone)[:-1] == 0
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                text = joined_words(raw, first[kept], last[kept], w.doc[kept], part.num_rows)
                cols = [part.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(runs, kind), text.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def longest(runs: F.Column) -> F.Column:
    """The run of greatest length; of several the first, and of these the one of smallest period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
