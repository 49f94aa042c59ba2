"""Periodic runs against a brute-force version, as runs, as collapsed texts and as the query's digests."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import periodic, queries
from tests.llm.test_operators import LONG


def brute_runs(w, least=12):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def brute_row(doc_id, text):
    """A row of the query, from its contract."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4), sha(lines), sha(brute_collapsed(w, runs)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def random_words(rng):
    kinds, n = rng.choice((1, 2, 3, 5, 40)), rng.choice((0, 1, 5, 11, 12, 13, 30, 80, 200, 500))
    w = [rng.randrange(kinds) for _ in range(n)]
    if n > 20 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("heavy", [True, False])
def test_runs_of_texts(heavy):
    """All runs are found, whether matches are counted by transforms or by pairs, many texts at once."""
    rng = random.Random(heavy)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        count = np.array([len(t) for t in texts])
        word = np.array([x for t in texts for x in t], np.uint64)
        if heavy:  # many equal words: groups over the size from which transforms count
            word[: len(word) // 2] %= np.uint64(2)
        cut = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(texts)), count)
        got = periodic.runs_of_texts(word, doc, count)
        assert got == [brute_runs(word[i : i + n].tolist()) for i, n in zip(cut, count)]


def test_counts_agree():
    rng = np.random.default_rng(4)
    for kinds in (1, 2, 7, 300):
        count = np.array([0, 900, 3, 0, 257, 1])
        word = rng.integers(0, kinds, count.sum()).astype(np.uint64)
        total, base = periodic.lag_counts(word, np.repeat(np.arange(6), count), count)
        for k, n in enumerate(count):
            own = word[count[:k].sum() : count[: k + 1].sum()]
            assert total[base[k] + 1 : base[k + 1]].tolist() == [int((own[q:] == own[:-q]).sum()) for q in range(1, n // 2 + 1)]


def test_one_word_is_scanned_once(monkeypatch):
    seen = []
    scan = periodic.islands
    monkeypatch.setattr(periodic, "islands", lambda w, lag, least: seen.append(lag) or scan(w, lag, least))
    n = 100_000
    assert periodic.runs_of_texts(np.zeros(n, np.uint64), np.zeros(n, int), np.array([n])) == [[(0, n, 1)]] and seen == [1]


def test_query(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k, " ".join(map(str, random_words(rng)))) for k in range(400)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "x\x00y " * 40), (504, "é ß  " * 9), (504, "é ß  " * 9), (505, LONG), (506, "a " * 3000 + "b " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "one": F.lit(2), "n_words": F.lit(3)})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, f"file://{tmp_path}").select(*COLUMNS).collect()]
    want = [brute_row(*r) for r in rows if r[0] != 505]
    key = lambda r: str(r)
    assert sorted((r for r in got if r[0] != 505), key=key) == sorted(want, key=key)
    long_ = next(r for r in got if r[0] == 505)  # w{i % 97}x{i % 13}: one run over all words, of period 97 * 13, unless planted otherwise
    assert long_[1] >= 1 and long_[4] <= 97 * 13


def test_edges(spark):
    rows = spark.createDataFrame([(None, "a " * 20), (1, None), (1, "a b " * 10), (1, "a b " * 10)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(rows).collect()), key=str)
    assert got == [(1, 0, [], ""), (1, 20, [(0, 20, 2)], "a b"), (1, 20, [(0, 20, 2)], "a b"), (None, 20, [(0, 20, 1)], "a")]
    assert periodic.periodic_runs(rows.limit(0)).count() == 0
    assert [len(r.runs) for r in periodic.periodic_runs(rows.filter("doc_id = 1 AND text IS NOT NULL"), least=21).collect()] == [0, 0]
