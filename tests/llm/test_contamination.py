"""Benchmark windows in documents against a brute-force version, and hot passages."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skyloom.llm import contamination
from tests.llm.test_operators import LONG, low

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w and item is not None else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("mark", "n_words", "shingle", "window", "item_id", "set", "of", "salt")}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("words", "size", "doc_id")})
    got = contamination.contamination(d, i, **more)
    return sorted((tuple(r)[:6] for r in got.collect()), key=str)


def tables(seed, n=80):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(30)] + ["é", "ß9", "Ab"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice((1, 2, 3, 9, 10, 11, 40)))) for k in range(25)]
    items += [(3, say(15)), (100, None), (101, ""), (102, "... !"), (None, say(12)), (103, items[4][1]), (1030, say(5) + " " + items[6][1])]
    docs = []
    for k in range(n):
        w = say(rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 2)):
            at, part = rng.randint(0, len(w)), rng.choice(items)[1] or ""
            w[at:at] = re.sub(r" ", lambda m: rng.choice((" ", ", ", "-", "\n")), part).upper().split(" ")
        docs.append((k, " ".join(w)))
    docs += [(None, items[7][1]), (None, None), (5, docs[5][1]), (5, "x " + (items[5][1])), (900, None), (901, ""), (902, "w1"), (903, LONG + " " + items[6][1])]
    return docs, items


@pytest.mark.parametrize(("part", "salted", "bits"), [(2_000, 100_000, 64), (1, 100_000, 64), (1, 2, 1)])
def test_contamination(spark, monkeypatch, part, salted, bits):
    """The same rows however shingles are dealt out and however coarse the map of bits is."""
    monkeypatch.setattr(contamination, "PLACES_A_PART", part)
    monkeypatch.setattr(contamination, "SALTED", salted)
    monkeypatch.setattr(contamination, "BITS_A_SHINGLE", bits)
    docs, items = tables(part)
    assert found(spark, docs, items) == brute(docs, items)


def test_other_windows(spark):
    docs, items = tables(9, 30)
    assert found(spark, docs, items, window=4, gram=2) == brute(docs, items, 4)


def test_empty(spark):
    docs, items = tables(2, 8)
    assert found(spark, [], items) == [] and found(spark, docs, []) == brute(docs, [])


def test_repeated_passages(spark):
    """One passage in most documents, many times in one, and shared by many items."""
    passage = " ".join(f"p{k % 7}q{k}" for k in range(30))
    items = [(k, f"i{k} {passage}") for k in range(50)] + [(99, "a a a a a a a a a a a a")]
    docs = [(k, f"x{k} {passage} y") for k in range(120)] + [(500, f"{passage} z " * 40), (501, "A " * 200)]
    assert found(spark, docs, items) == brute(docs, items)
