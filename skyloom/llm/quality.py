"""Text quality by Bradley-Terry ranking.

Each text has a vector of shape features. Preference pairs are one good and
one poor labelled text; the weights minimise the logistic loss of the feature
differences, so a text's worth is a weighted sum. The threshold is the
quantile of the training texts' worths at the share of poor labels, and the
score is a logistic curve of the worth that passes through CUT there.

Defined cases: a null or empty text has the features of no words; without
labels of both kinds all scores are the share of good labels (0 without any);
repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import words
from skyloom.llm.common import map_arrow, slices, utf8
from skyloom.llm.labelled import Adam, held_out, labelled_sample, sigmoid

#: Labelled texts that training sees, and preference pairs made of them, at most.
TRAIN_TEXTS = 20_000
TRAIN_PAIRS = 60_000
#: Score of a text at the threshold.
CUT = 0.3
STEPS = 400


def _class(*of: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


BYTE_CLASSES = [
    _class(*range(0x30, 0x3A)),
    _class(*range(0x41, 0x5B)),
    _class(*b".!?"),
    _class(*b",;:'\"()-"),
    _class(*b"|/\\_=+<>[]{}~^`"),
    _class(*b"#$%&*@"),
    _class(0x0A),
    words.SPACES,
    _class(*range(0x80, 0x100)),
]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) shape features of whole texts."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    cols = [np.log1p(size)]
    for has in BYTE_CLASSES:
        sums = np.concatenate([[0], np.cumsum(has[raw], dtype=np.int64)])
        share = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)
        cols += [share, np.sqrt(share)]
    w = words.split(raw, offsets, ~words.SPACES)
    h = words.hashes(raw, w.start, w.end)
    length = (w.end - w.start).astype(float)
    count = w.count.astype(float)
    many = np.maximum(count, 1)
    mean = np.bincount(w.doc, length, n) / many
    cols += [np.log1p(count), mean, np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / many - mean**2, 0))]
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    cols.append(np.log1p(longest))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    cols.append(np.bincount(w.doc, again, n) / many)
    terms = np.concatenate([[0], np.cumsum(words.TERM[raw], dtype=np.int64)])
    cols.append(np.bincount(w.doc, terms[w.end] == terms[w.start], n) / many)
    ends = np.cumsum(w.count)
    distinct, top = np.zeros(n), np.zeros(n)
    for k, (i, j) in enumerate(zip((ends - w.count).tolist(), ends.tolist(), strict=True)):
        if j > i:
            s = np.sort(h[i:j])
            runs = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[k], top[k] = len(runs) - 1, np.diff(runs).max()
    cols += [distinct / many, np.log1p(distinct), top / many, np.log1p(count) - np.log1p(distinct)]
    return np.stack(cols, 1)


class Ranking(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float
    constant: float | None  # the score of every text if there was nothing to rank


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, cut to 5 deviations, and their squares."""
    z = np.clip((x - mean) / scale, -5, 5)
    return np.concatenate([z, z * z], 1)


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Ranking:
    """Fit weights to pairs of a good (1) and a poor (0) text."""
    if not len(y) or y.min() == y.max():
        return Ranking(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 1.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(5)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = expand(x, mean, scale)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(TRAIN_PAIRS, 8 * max(len(good), len(poor)))
    diff = z[rng.choice(good, n)] - z[rng.choice(poor, n)]
    weight = np.zeros(z.shape[1])
    adam = Adam([weight], 0.03)
    for _ in range(steps):
        part = diff[rng.integers(0, n, min(n, 4096))]
        d = sigmoid(part @ weight) - 1
        adam.go([part.T @ d / len(part) + 1e-3 * weight])
    worth = z @ weight
    threshold = float(np.quantile(worth, len(poor) / len(y)))
    slope = np.zeros(1)
    fit_slope = Adam([slope], 0.05)
    shift = np.log(CUT / (1 - CUT))
    for _ in range(200):
        fit_slope.go([np.array([((sigmoid(slope * (worth - threshold) + shift) - y) * (worth - threshold)).mean()])])
    return Ranking(mean, scale, weight, threshold, float(max(slope[0], 1e-3)), None)


def quality_scores(x: np.ndarray, r: Ranking) -> np.ndarray:
    if r.constant is not None:
        return np.full(len(x), r.constant)
    return sigmoid(r.slope * (expand(x, r.mean, r.scale) @ r.weight - r.threshold) + np.log(CUT / (1 - CUT)))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS) -> Ranking:
    """Learn from a bounded sample of the labelled rows that are not held out."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([features(*utf8(part.column("text"))) for part in slices(batch, "text")])
        rows = pa.array([v.tobytes() for v in x], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows], ["doc_id", "label", "x"])

    rows = map_arrow(labelled_sample(docs, labels, "quality", most), one, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    x = np.array([np.frombuffer(v) for v in rows.column("x").to_pylist()])
    return train(x, rows.column("label").to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= CUT) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [quality_scores(features(*utf8(part.column("text"))), shared.value) for part in slices(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
