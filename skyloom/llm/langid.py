"""Language identification by a byte convolutional network.

A byte embedding, filters over 2, 3 and 4 bytes, max pooling and softmax,
trained with numpy on windows of labelled texts. A whole text is cut into
windows of fixed length, all of them are scored, and the text's score is the
mean over its windows, weighted by their bytes.

Defined cases: a null text, and one without any letter, is ``und`` with score
0; rows whose lang is null are never learned from; without any labelled row
every text is ``und``; repeated rows give a row each; extra columns are
ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import crc_mod, map_arrow, map_batches, slices, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDED = 8
#: Labelled texts of each language and windows of each text that training sees, at most.
TRAIN_TEXTS = 800
TRAIN_WINDOWS = 4
STEPS = 700
UNDETERMINED = "und"

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Network(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # 256, EMBEDDED
    filters: np.ndarray  # 4 * EMBEDDED, filters; rows beyond a filter's width are 0
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, zero-padded: (windows, WINDOW) bytes, each one's text, and its own bytes."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    at = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(at[-1] * WINDOW, np.uint8)
    if len(raw):
        out[np.arange(len(raw)) + np.repeat(at[:-1] * WINDOW - offsets[:-1], sizes)] = raw
    doc = np.repeat(np.arange(len(sizes)), per)
    own = np.minimum(WINDOW, sizes[doc] - (np.arange(at[-1]) - at[doc]) * WINDOW)
    return out.reshape(-1, WINDOW), doc, own


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Fit the network to windows (n, WINDOW) of bytes and their language numbers by Adam."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    width = max(WIDTHS)
    mask = np.zeros((width, EMBEDDED, n_filters), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(width * EMBEDDED, n_filters)
    p = [
        rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
        rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    ]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    counts = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / np.maximum(counts, 1) / len(languages))[labels]
    chance = weight / weight.sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(labels), 64, p=chance)
        x, y = texts[pick], labels[pick]
        padded = np.pad(x, ((0, 0), (0, width - 1)))
        patch = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)
        embedded = p[0][patch].reshape(len(x), WINDOW, width * EMBEDDED)
        out = embedded @ p[1] + p[2]
        best = out.argmax(1)
        pooled = np.maximum(np.take_along_axis(out, best[:, None], 1)[:, 0], 0)
        prob = softmax(pooled @ p[3] + p[4])
        d = prob
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dp = (d @ p[3].T) * (pooled > 0)
        at = np.take_along_axis(embedded, best[:, :, None], 1)  # text, filter, patch
        g_filters = np.einsum("nfe,nf->ef", at, dp) * mask
        g_embedding = np.zeros_like(p[0])
        d_patch = (dp[:, :, None] * p[1].T[None]).reshape(len(x), n_filters, width, EMBEDDED)
        np.add.at(g_embedding, np.take_along_axis(patch, best[:, :, None], 1), d_patch)
        grads = [g_embedding, g_filters, dp.sum(0), pooled.T @ d + 1e-4 * p[3], d.sum(0)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= 0.01 * (1 - 0.7 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, *p)


class Scorer:
    """A network as two tables over byte pairs: a filter's value is pairs[a, b] + later[c, d]."""

    def __init__(self, net: Network):
        self.net = net
        parts = np.einsum("be,wef->wbf", net.embedding, net.filters.reshape(max(WIDTHS), EMBEDDED, -1))
        self.pairs = (parts[0][:, None] + parts[1][None] + net.bias).reshape(65536, -1).astype(np.float32)
        self.later = (parts[2][:, None] + parts[3][None]).reshape(65536, -1).astype(np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language for windows (n, WINDOW) of bytes."""
        out = np.empty((len(x), self.pairs.shape[1]), np.float32)
        for i in range(0, len(x), 64):
            padded = np.pad(x[i : i + 64], ((0, 0), (0, 3))).astype(np.int32)
            pair = padded[:, :-1] << 8 | padded[:, 1:]
            values = self.pairs.take(pair[:, :-2], axis=0)
            values += self.later.take(pair[:, 2:], axis=0)
            out[i : i + 64] = values.max(1)
        return softmax(np.maximum(out, 0) @ self.net.dense + self.net.dense_bias)


def training_rows(docs: DataFrame, learn) -> DataFrame:
    """A bounded sample of labelled texts: up to TRAIN_TEXTS of each language, by a hash of doc_id."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    ids = labelled.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    for keys in (["lang", F.pmod("h", F.lit(64))], ["lang"]):  # a frequent language is cut down in 64 parts first
        by = Window.partitionBy(*keys).orderBy("h", "doc_id")
        ids = ids.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= TRAIN_TEXTS).drop("k")
    text = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    cuts = F.array(*(F.substring(text, (F.floor(F.greatest(size - WINDOW, F.lit(0)) * (k / max(1, TRAIN_WINDOWS - 1))) + 1).cast("int"), F.lit(WINDOW)) for k in range(TRAIN_WINDOWS)))
    return labelled.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "lang", cuts.alias("cuts"))


def fit(docs: DataFrame, learn) -> Network | None:
    """A network learned from the rows for which the condition learn holds."""
    rows = training_rows(docs, learn).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0))
    cut = [(c, r.lang) for r in rows for c in r.cuts if c]
    if not cut:
        return None
    languages = sorted({lang for _, lang in cut})
    texts = np.frombuffer(b"".join(bytes(c).ljust(WINDOW, b"\0") for c, _ in cut), np.uint8).reshape(-1, WINDOW)
    number = {lang: k for k, lang in enumerate(languages)}
    return train(texts, np.array([number[lang] for _, lang in cut]), languages)


def identify(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Language and score of every whole text under the given names, beside the columns in keep."""
    kept = docs.select(*keep, *(() if "text" in keep else ("text",)))
    if net is None:
        return kept.select(*keep, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep), f"{names[0]} string", f"{names[1]} double"])

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            told, scores = [], []
            for part in slices(batch, "text", 1 << 20):
                raw, offsets = utf8(part.column("text"))
                x, doc, own = windows(raw, offsets)
                n = part.num_rows
                mean = np.zeros((n, len(scorer.net.languages)))
                if len(x):
                    prob = scorer.probabilities(x) * own[:, None]
                    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    mean[doc[starts]] = np.add.reduceat(prob, starts, 0) / np.add.reduceat(own, starts)[:, None]
                letters = np.concatenate([[0], np.cumsum(LETTER[raw])])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for k in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[k] = any(map(str.isalpha, part.column("text")[k].as_py()))
                best = mean.argmax(1)
                told += [scorer.net.languages[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                scores.append(np.where(has, np.clip(mean[np.arange(n), best], 0, 1), 0.0))
            if told:
                cols = [batch.column(c) for c in keep] + [pa.array(told, pa.string()), pa.array(np.concatenate(scores), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *names])

    return map_batches(kept, run, out_schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those whose crc32(doc_id) mod 3 is not 1.

    Returns doc_id, held_out, lang_pred, score.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    net = fit(docs, ~held_out)
    return identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
