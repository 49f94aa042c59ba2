"""Bounded samples of labelled documents, as features, for training on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import crc_mod


def held_out() -> F.Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return crc_mod(F.col("doc_id").cast("long"), 5) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of up to `most` labelled rows that are not held out, least hash of doc_id first.

    A doc_id with several labels has the greatest; the ids of the sample are
    bounded by `most` and so are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    picked = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps over a list of arrays."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def go(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, m, v, g in zip(self.params, self.m, self.v, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
