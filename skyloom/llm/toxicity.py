"""Toxicity by a factorization machine over hashed terms.

A term is a run of letters and digits, lower-cased in A-Z, or the first STEM
bytes of a longer one; its feature is whether a text has it. Terms are hashed
to TABLE places. The machine adds to the linear weights an inner product of
factors for each pair of terms that stand in one text, such as an insult and a
group that it is aimed at.

A term is in the machine if it is clearly more frequent among toxic training
texts, or if it is so among those training texts that hold one of the PAIR_TERMS clearest:
a group that clean texts name as often comes in by the insults beside it. What
is common elsewhere does not excuse an insult. Terms, and pairs of a known term
and another one, are counted in Spark over the training texts; the driver gets
the chosen terms, and the texts as their numbers.

Defined cases: a null or empty text has the score of no terms; without labels
of both kinds all scores are the share of toxic labels (0 without any); labels
that are null or neither 0 nor 1 are left out, and of several for a doc_id the
greatest counts; of equally clear terms the smaller hash comes first; texts are
read whole, very long ones too, in parts of bounded size; rows that repeat a
doc_id or all values, and rows without doc_id (whose held_out is that of an
empty id), give a row each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import words
from skyloom.llm.common import map_arrow, materialise, slices, utf8
from skyloom.llm.labelled import Adam, held_out, labelled_sample, sigmoid

TABLE_BITS = 20
#: Bytes of a stem: insults in inflected languages share little more.
STEM = 4
FACTORS = 8
#: Labelled texts that training sees, at most.
TRAIN_TEXTS = 20_000
#: Terms that the machine keeps for themselves, and for a pair, at most each, the least differences in standard errors and the least number of texts of a pair.
KEPT_TERMS = 4096
LEAST_Z, PAIR_Z = 4.0, 6.0
PAIR_TEXTS = 8
#: How many times as frequent it is among the toxic texts of a pair: in longer texts all terms are somewhat more frequent.
PAIR_LIFT = 4.0
#: The clearest terms, beside which others are looked for.
PAIR_TERMS = 64
STEPS = 800
#: Numbers of the dense matrix of texts and frequent terms in training.
DENSE_CELLS = 8_000_000


class Machine(NamedTuple):
    place: np.ndarray  # TABLE: number of a kept term, or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) of all terms of all texts, and of the stems of longer terms."""
    w = words.split(raw, offsets, words.TERM)
    long_ = w.end - w.start > STEM
    whole = words.hashes(raw, w.start, w.end)
    stems = words.hashes(raw, w.start[long_], w.start[long_] + STEM) ^ np.uint64(0x6A09E667F3BCC908)
    every = np.concatenate([whole, stems]) >> np.uint64(64 - TABLE_BITS)
    return np.concatenate([w.doc, w.doc[long_]]), every.astype(np.int64)


def scores(doc: np.ndarray, term: np.ndarray, n: int, m: Machine) -> np.ndarray:
    """Raw scores of n texts with distinct (text, kept term) pairs ordered by text."""
    total = m.bias + np.bincount(doc, m.linear[term], n)
    if len(doc):
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        v = m.factors[term]
        together = np.add.reduceat(v, starts, 0)
        alone = np.add.reduceat((v * v).sum(1), starts)
        total[doc[starts]] += 0.5 * ((together * together).sum(1) - alone)
    return total


def pairs(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs."""
    key = np.unique(doc << 32 | term)
    return key >> 32, key & 0xFFFFFFFF


def flat(share: float) -> Machine:
    """A machine without terms that gives every text the same score."""
    bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    return Machine(np.full(1 << TABLE_BITS, -1, np.int32), bias, np.zeros(1), np.zeros((1, FACTORS)))


class Incidence:
    """Which texts have which terms, for sums over a text's terms and over a term's texts.

    The terms that most texts have are columns of a dense matrix of at most
    DENSE_CELLS numbers; the other pairs are kept in the order of texts and in
    that of terms, so that either sum is of neighbouring rows.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, n: int, n_terms: int):
        self.n, self.n_terms = n, n_terms
        often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[: DENSE_CELLS // max(1, n)]
        column = np.full(n_terms, -1, np.int64)
        column[often] = np.arange(len(often))
        own = column[term] >= 0
        self.often, self.dense = often, np.zeros((n, len(often)))
        self.dense[doc[own], column[term[own]]] = 1
        doc, term = doc[~own], term[~own]
        by_term = np.argsort(term, kind="stable")
        self.by_doc, self.by_term = (self.runs(doc, term), self.runs(term[by_term], doc[by_term]))

    @staticmethod
    def runs(to: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
        return to[starts], starts, of

    @staticmethod
    def add(out: np.ndarray, rows: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        to, starts, of = runs
        if len(to):
            out[to] += np.add.reduceat(rows[of], starts, 0)
        return out

    def over_terms(self, rows: np.ndarray) -> np.ndarray:
        """For each text the sum of its terms' rows."""
        return self.add(self.dense @ rows[self.often], rows, self.by_doc)

    def over_texts(self, rows: np.ndarray) -> np.ndarray:
        """For each term the sum of its texts' rows."""
        out = np.zeros((self.n_terms, rows.shape[1]))
        out[self.often] = self.dense.T @ rows
        return self.add(out, rows, self.by_term)


def train(texts: list[np.ndarray], y: np.ndarray, place: np.ndarray, steps: int = STEPS) -> Machine:
    """Fit the machine to texts given as distinct numbers of kept terms; place has the number of each hashed term."""
    n1, n0 = y.sum(), len(y) - y.sum()
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    term = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
    rng = np.random.default_rng(11)
    n_terms = max(1, int(place.max()) + 1)
    bias, linear, factors = np.full(1, np.log(n1 / n0)), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))
    adam = Adam([bias, linear, factors], 0.1)
    has = Incidence(doc, term, len(y), n_terms)
    for _ in range(steps):
        sums = has.over_terms(np.column_stack([factors, linear, (factors * factors).sum(1)]))
        together = sums[:, :FACTORS]
        out = bias[0] + sums[:, FACTORS] + 0.5 * ((together * together).sum(1) - sums[:, FACTORS + 1])
        d = (sigmoid(out) - y) / len(y)
        back = has.over_texts(np.column_stack([d[:, None] * together, d]))
        g_factors = back[:, :FACTORS] - back[:, FACTORS:] * factors
        adam.go([np.array([d.sum()]), back[:, FACTORS] + 1e-6 * linear, g_factors + 1e-4 * factors])
    return Machine(place, float(bias[0]), linear, factors)


def distance(n: F.Column, toxic: F.Column, n_all: F.Column, toxic_all: F.Column) -> F.Column:
    """By how many standard errors something that n texts have, toxic of them toxic ones, is more frequent among the toxic ones of all."""
    clean_all, p = n_all - toxic_all, n / n_all
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / toxic_all + 1 / clean_all))
    return (toxic / toxic_all - (n - toxic) / clean_all) / error


def counted(rows: DataFrame, keys) -> DataFrame:
    """key, n and toxic: the texts that have a key, and the toxic ones of them. keys gives the keys of a text from its terms."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(keys(np.frombuffer(t, np.int32)), y) for t, y in zip(batch.column("terms").to_pylist(), batch.column("label").to_pylist(), strict=True)]
        key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        y = np.concatenate([np.full(len(k), y) for k, y in found])
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)), pa.array(np.bincount(at, y, len(key)).astype(np.int64))], ["key", "n", "toxic"])

    return map_arrow(rows, one, "key long, n long, toxic long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def kept_terms(rows: DataFrame, n: int, toxic: int) -> np.ndarray:
    """The hashed terms of the machine, clearest first: those that tell by themselves, then those that tell beside one of these."""
    single = materialise(counted(rows, lambda t: t), "terms-counted")
    z = distance(F.col("n"), F.col("toxic"), F.lit(n), F.lit(toxic))
    known = single.withColumn("z", z).filter((F.col("n") >= 4) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "key").limit(KEPT_TERMS).select("key", "n", "toxic").toArrow()
    alone = known.column("key").to_numpy()
    if not len(alone):
        return alone
    place, often = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, bool)
    place[alone[:PAIR_TERMS]] = np.arange(min(len(alone), PAIR_TERMS))
    often[single.filter(F.col("n") >= PAIR_TEXTS).select("key").toArrow().column("key").to_numpy()] = True
    often[alone] = False
    shared = rows.sparkSession.sparkContext.broadcast((place, often))

    def beside(terms: np.ndarray) -> np.ndarray:
        """Pairs of a known term's number and another frequent term, as one number."""
        place, often = shared.value
        number = place[terms]
        return ((number[number >= 0][:, None] << TABLE_BITS) | terms[often[terms]][None]).ravel()

    of = rows.sparkSession.createDataFrame(known.select(["n", "toxic"]).slice(0, PAIR_TERMS).rename_columns(["n_all", "toxic_all"]).append_column("number", pa.array(range(min(len(alone), PAIR_TERMS)), pa.int64())))
    pair = counted(rows, beside).filter(F.col("n") >= PAIR_TEXTS).withColumns({"number": F.shiftright("key", TABLE_BITS), "term": F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))})
    told = pair.join(F.broadcast(of), "number").filter((F.col("toxic_all") >= PAIR_TEXTS) & (F.col("n_all") - F.col("toxic_all") >= PAIR_TEXTS))
    told = told.withColumn("z", distance(F.col("n"), F.col("toxic"), F.col("n_all"), F.col("toxic_all"))).filter(F.col("z") >= PAIR_Z)
    clean, clean_all = F.col("n") - F.col("toxic"), F.col("n_all") - F.col("toxic_all")
    told = told.filter(F.col("toxic") * clean_all >= PAIR_LIFT * clean * F.col("toxic_all"))
    more = told.groupBy("term").agg(F.max("z").alias("z")).orderBy(F.desc("z"), "term").limit(KEPT_TERMS).select("term").toArrow()
    return np.concatenate([alone, more.column("term").to_numpy()])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS) -> Machine:
    """Learn from a bounded sample of the labelled rows that are not held out."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for part in slices(batch, "text"):
            doc, term = pairs(*terms(*utf8(part.column("text"))))
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            term = term.astype(np.int32)
            out += [term[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "terms"])

    rows = materialise(map_arrow(labelled_sample(docs, labels, "toxic", most), one, "doc_id long, label int, terms binary"), "terms")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return flat(toxic / n if n else 0.0)
    kept = kept_terms(rows, n, toxic)
    place = np.full(1 << TABLE_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value[np.frombuffer(t, np.int32)] for t in batch.column("terms").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([np.sort(x[x >= 0]).tobytes() for x in found], pa.binary())], ["doc_id", "label", "numbers"])

    sample = map_arrow(rows, numbered, "doc_id long, label int, numbers binary").toArrow().sort_by([("doc_id", "ascending"), ("numbers", "ascending")])
    return train([np.frombuffer(t, np.int32) for t in sample.column("numbers").to_pylist()], sample.column("label").to_numpy().astype(float), place)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, out = shared.value, []
        for part in slices(batch, "text"):
            doc, term = terms(*utf8(part.column("text")))
            term = m.place[term].astype(np.int64)
            out.append(sigmoid(scores(*pairs(doc[term >= 0], term[term >= 0]), part.num_rows, m)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
