"""Corpus operators against brute-force versions on small fixtures, and their defined edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import bpe, components, fingerprints, jaccard, knn, langid, mixing, quality, suffix_dedup, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, n long"
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(30_000))


def corpus(seed=3, n=60):
    """Random documents with near copies, exact copies, shared passages, periodic and odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    line = " ".join(rng.choice(vocab) for _ in range(14))
    texts = []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        kind = k % 6
        if kind == 1 and texts:
            base = rng.choice(texts).split(" ")
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 2:
            w[len(w) // 2 : len(w) // 2] = passage.split(" ")
        elif kind == 3:
            w = w + [line] + w[:5] + [line]
        elif kind == 4 and texts:
            w = rng.choice(texts).split(" ")
        texts.append(" ".join(w))
    texts += [None, "", " \n\t", "aaaaaaaaaa" * 40, "de " * 120, "one two three", "ONE two THREE", "1234 ???", "a\x00b " * 40]
    return [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, 7, 9) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small_region", [24, 6, 1])
def test_jaccard_groups(docs, rows, monkeypatch, small_region):
    monkeypatch.setattr(jaccard, "SMALL_REGION", small_region)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(docs).collect()}
    assert got == brute_groups(rows)


def clustered_sets(rng, n_groups, each, common=40):
    """Texts of groups of near copies that all share one passage, some near across groups."""
    passage = [f"p{i}" for i in range(common)]
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{i}" for i in range(rng.randint(20, 200))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(passage + w))
    return out


@pytest.mark.parametrize(("leaf", "block"), [(128, 4096), (4, 4096), (3, 20)])
def test_jaccard_cells(spark, monkeypatch, leaf, block):
    """Recursive cells in one large region give the groups of brute force."""
    monkeypatch.setattr(jaccard, "SMALL_REGION", 2)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "REGION_BLOCK", block)
    rows = list(enumerate(clustered_sets(random.Random(leaf), 12, 7)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_possible_pairs_lose_nothing(monkeypatch):
    """All pairs that are near come out of the cells, whatever their size; far groups never meet."""
    rng = random.Random(9)
    texts = clustered_sets(rng, 20, 9, 10)
    sets = [np.unique(words.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1]) for t in texts]
    n = np.array([len(x) for x in sets])
    marks = jaccard.sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n)
    marks[5] = marks[77] = b""
    k = np.arange(len(sets))
    part = pa.table({"key": k, "component": k, "n": n, "own": k % 3, "i": 0 * k, "j": 0 * k, "sketch": marks})
    near = {(a, b) for a in k for b in k if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert len(near) > 50
    for leaf in (2, 10, 1000):
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        found = [p for a, b in jaccard.possible_pairs(part, (75, 100)) for p in zip(a.tolist(), b.tolist())]
        assert near <= set(found)


def test_jaccard_edge_rows(spark, empty):
    assert jaccard.near_groups(empty).count() == 0
    text = "a b c d e f g h i j"
    twice = [(1, text), (1, text), (1, "q r s t u v"), (2, "q r s t u v"), (None, text), (3, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(spark.createDataFrame(twice, "doc_id long, text string")).collect()}
    assert {(1, 6, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)} <= got
    assert len([g for g in got if g[0] is None]) == 1


def test_jaccard_copy_without_id_first(spark):
    w = [f"w{i}" for i in range(60)]
    text, near = " ".join(w), " ".join([*w[:-1], "other"])
    rows = spark.createDataFrame([(None, text), (5, text), (4, near)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(rows).collect() if r.doc_id is not None}
    assert got == {5: 4, 4: 4}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def brute_removed(rows, length=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(raw), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize(("most", "sample", "frequent"), [(1000, 16, 32), (2, 16, 32), (1000, 1, 2), (1, 1, 3)])
def test_suffix_dedup(docs, rows, monkeypatch, most, sample, frequent):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_removed(rows)


def test_suffix_dedup_of_texts_with_nul_bytes(spark):
    """Suffixes that differ in NUL bytes at their ends only are in order, so no interval is lost."""
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab\0\0\0") for _ in range(rng.randint(1, 90))) for _ in range(12)] + ["\0" * 130, "x" + "\0" * 99]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) + "\0" * rng.choice((0, 1, 2, 99))) for i in range(150)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_removed(rows)
    for _ in range(40):
        short = [("".join(rng.choice("a\0") for _ in range(rng.randint(4, 14))).encode(), k, 0, 0) for k in range(9)]
        short = list({c[0]: c for c in short}.values())
        found = suffix_dedup.removed_spans(short, 4)
        want = brute_removed([(c[1], c[0].decode()) for c in short], 4)
        assert {int(d): int(sum(found[2][found[0] == d] - found[1][found[0] == d])) for d in found[0]} == {d: w[1] for d, w in want.items() if w[1]}


def test_suffix_dedup_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    p = "x".join(str(i) for i in range(60))
    got = suffix_dedup.without_repeats(spark.createDataFrame([(2, p, 1), (1, p, 2), (None, p, 3), (3, None, 4)], "doc_id long, text string, n_chars long")).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in got} == {(1, p, len(p)), (2, "", 0), (None, p, len(p)), (3, "", 0)}


def test_bpe(docs, rows, spark, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: r for r in bpe.bpe_digests(bpe.bpe_encode_decode(docs)).collect()}
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(back))
    odd = ["<|endoftext|>a", "x<|endoftext|><|endoftext|>", "it's  we'll\n\n", "日本🙂", "\x1c\x85 x", LONG]
    for t in odd:
        m = bpe.Bpe(open(bpe.default_tokenizer(), "rb").read())
        assert m.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert bpe.bpe_encode_decode(empty).count() == 0


def test_edit_aware_counts(spark, empty):
    m = bpe.Bpe(open(bpe.default_tokenizer(), "rb").read())
    rng = random.Random(5)
    base = [t for _, t, *_ in corpus(9, 20) if t] + [LONG[:9000], ""]
    for _ in range(150):
        text = rng.choice(base)
        tree = bpe.CountTree(m, text)
        for _ in range(3):
            i = rng.randint(0, len(text))
            j = min(len(text), i + rng.choice([0, 1, 5, 400]))
            new = rng.choice(["", " ", "'", "ll", "x", "\n\n", "<|endof", "text|>", "<|endoftext|>", "the end " * 40])
            tree.edit(i, j, new)
            text = text[:i] + new + text[j:]
            assert (tree.total, tree.length) == (len(m.encode(text)), len(text))
    edits = "array<struct<start:int,stop:int,text:string>>"
    df = spark.createDataFrame([(1, LONG, [(500, 600, "new words")]), (2, None, None), (3, "", [(0, 9, "a b")])], f"doc_id long, text string, edits {edits}")
    got = {r.doc_id: r for r in bpe.token_counts(df).collect()}
    assert got[1].edited_tokens == len(m.encode(LONG[:500] + "new words" + LONG[600:]))
    assert got[1].reencoded < got[1].n_pieces / 20
    assert (got[2].n_tokens, got[2].edited_tokens, got[3].n_tokens, got[3].edited_tokens) == (0, 0, 0, 2)
    assert bpe.token_counts(empty.withColumn("edits", F.lit(None).cast(edits))).count() == 0


def brute_likeness(t, u):
    """Jaccard likeness of the texts' segments, by bytes and with repeats."""
    if t == u:
        return 1.0
    x, y = (Counter(p for line in s.encode().splitlines(keepends=True) for p in fingerprints.SEGMENT.findall(line) if p) for s in (t, u))
    both = sum(min(n, y[p]) * len(p) for p, n in x.items())
    return both / (len(t.encode()) + len(u.encode()) - both)


def test_fingerprints(docs, rows, spark, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    texts = [t or "" for _, t, *_ in rows]
    for i, t in enumerate(texts):
        cut, following = len(t) // 4, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - cut] + following[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == 1 if edited == t else 0 <= got[i].near_edited < 1
        assert math.isclose(got[i].near_edited, brute_likeness(t, edited), abs_tol=1e-8)
        assert math.isclose(got[i].near_next, brute_likeness(t, following), abs_tol=1e-8)
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            assert (got[i].fingerprint == got[j].fingerprint) == (t == u)
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1
    odd = spark.createDataFrame([(None, "x"), (2, "b"), (2, "a"), (9, None)], "doc_id long, text string")
    assert [r.doc_id for r in fingerprints.fingerprints(odd).collect()].count(2) == 2


def test_fingerprints_of_far_ids_and_long_texts(spark):
    ids = [-(2**63), -5, 0, 1, 2, 3, 4, 10**15, 2**63 - 1]
    rows = [(i, f"text number {k}. It has {k} parts.\n" * (k + 1) if i else LONG, "x", 1) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, head int")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert set(got) == set(ids)
    for k, (i, t, *_) in enumerate(rows):
        cut, following = len(t) // 4, rows[(k + 1) % len(rows)][1]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()


def test_merkle_branches():
    text = "\n".join(f"Line {i} of the text. It has two sentences." for i in range(200))
    a, b = fingerprints.merkle_tree(text), fingerprints.merkle_tree(text.replace("Line 77 of", "Line 77 off"))
    spans = fingerprints.differing(b, a)
    raw = text.replace("Line 77 of", "Line 77 off").encode()
    assert len(spans) == 1 and b"Line 77 off" in raw[spans[0][0] : spans[0][1]] and spans[0][1] - spans[0][0] < 80
    assert fingerprints.differing(a, a) == []


def test_top_products(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    vectors += [(400 + i, [0.25] * 8) for i in range(120)] + [(600, None), (601, [float("nan")] * 8), (602, [1.0, None]), (603, [2.0]), (604, []), (None, [1.0] * 8), (40, vectors[40][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in knn.top_products(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    own = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i] = [math.floor(64 * x) for x in v]
    for q in own:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(own[q], own[o])), o) for o in own if o != q)[:20]
            assert sorted(got[q]) == [(k + 1, o, -p) for k, (p, o) in enumerate(s)]
    assert knn.top_products(df.limit(0)).count() == 0
    assert knn.top_products(df.filter("vec_id = 20")).count() == 0


def test_top_products_of_any_size(spark):
    """Queries without length, products beyond a double's whole numbers, beyond 64 bits and beyond a double."""
    for far in (2.0**24, 2.0**40, 1e200):
        rows = [(i, [far * (1 + i % 7), -3.0 * i, 0.25 * (i % 3)]) for i in range(60)] + [(80, [0.0, 0.0, 0.0]), (81, [0.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        own = {i: [math.floor(64 * x) for x in v] for i, v in rows}
        got = {}
        for r in knn.top_products(df).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == {0, 20, 40, 80}
        for q in got:
            held = lambda p: min(max(p, -(2**63)), 2**63 - 1)
            s = sorted((-held(sum(a * b for a, b in zip(own[q], own[o]))), o) for o in own if o != q)[:20]
            assert sorted(got[q]) == [(k + 1, o, -p) for k, (p, o) in enumerate(s)]


def test_clusters_are_pruned(spark):
    """On clustered vectors at most half of the pairs of query group and vector are sent."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.floor(64 * (centres[np.arange(3000) % 30] + 0.05 * rng.normal(size=(3000, 16))))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    queries = data.filter("vec_id % 20 = 0")
    sp = knn.space(data, queries)
    wide, bound, n = knn.summaries(data, queries, sp, 21)
    row, group = knn.sendings(x, sp, np.where(n > 0, bound + wide, -1.0))
    assert n[group].sum() <= 0.5 * len(x) * n.sum()


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets of sources in code point order (null last), by sharing again until no source is above its cap."""
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[k] for k in full)
        open_ = [k for k in order if k not in full]
        share = {k: rest * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > most * sizes[k]}
        if not over:
            return {k: most * sizes[k] if k in full else share[k] for k in order}
        full |= over


def brute_rate(size, sizes, target, most=3.0):
    """exp(tilt * size), at most `most`, with the tilt at which the source's words meet the target, by bisection."""
    if target >= most * sizes.sum() * (1 - 1e-6):
        return most
    low, high = -60.0 / sizes.min(), 60.0 / sizes.min()
    for _ in range(300):
        mid = (low + high) / 2
        words = (np.minimum(np.exp(np.minimum(mid * sizes, 60)), most) * sizes).sum()
        low, high = (mid, high) if words < target else (low, mid)
    return min(most, math.exp(min(low * size, 60)))


def test_mixing(docs, rows, spark, empty):
    got = mixing.mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert {r.doc_id: r.size for r in got} == size
    of = {s: np.array([size[i] for i, _, _, x, *_ in rows if x == s]) for s in ("s0", "s1", "s2")}
    target = brute_targets({s: int(x.sum()) for s, x in of.items()})
    for r in got:
        assert r.source_size == of[r.source].sum() and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        sizes = of[r.source]
        assert not r.size or math.isclose(r.rate, brute_rate(r.size, sizes[sizes > 0], r.target), rel_tol=1e-3)
    for source in of:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - target[source]) <= max(30, 0.02 * target[source])
        assert all(r.taken == r.copies * r.size <= 3 * r.size for r in own)
    for again in (docs.repartition(3), docs.repartition(11, "text"), docs.orderBy(F.desc("n_chars")).coalesce(1)):
        assert sorted((r.doc_id, r.copies, r.rate) for r in mixing.mix(again).collect()) == sorted((r.doc_id, r.copies, r.rate) for r in got)


def test_mixing_targets_with_caps(spark):
    sizes = {"a": 10, "b": 100, "c": 100, "d": 3, "B": 40, "é": 500, None: 7, "z0": 0}
    rows = [(k, s, 1) for k, s in sizes.items()]
    found = mixing.source_targets(spark.createDataFrame(rows, "source string, size long, docs long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.source_size for r in found} == sizes
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) for r in found)


def test_mixing_edges(spark, empty):
    odd = spark.createDataFrame([(1, None, None), (2, "a b", None), (2, "a b", None), (None, "a", "z"), (3, LONG, "z"), (3, "x", "z")], "doc_id long, text string, source string")
    got = mixing.mix(odd).collect()
    assert sum(r.size for r in got) == 6 + 30_000 and len(got) == 6
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns
    assert mixing.mix(odd.filter("text is null")).first().taken == 0
    # rows that repeat a doc_id are taken as often as each on its own
    wide = odd.withColumns({"size": F.lit(1), "mark_of": F.lit(2), "copies": F.lit(3), "_id": F.lit(4)})
    whole = mixing.mixed(wide)
    assert whole.columns == wide.columns
    words_of = lambda t: len((t or "").split())
    taken = {}
    for r in got:
        taken[(r.doc_id, r.size)] = taken.get((r.doc_id, r.size), 0) + r.copies
    seen = {}
    for r in whole.collect():
        seen[(r.doc_id, words_of(r.text))] = seen.get((r.doc_id, words_of(r.text)), 0) + 1
    assert seen == {k: n for k, n in taken.items() if n}


def labelled(spark, n=400):
    """Texts of two languages; a few insults make a text toxic, tables make it poor."""
    rng = random.Random(4)
    en, fr = ["the", "house", "of", "with", "thing", "water", "road"], ["le", "été", "maison", "qui", "français", "eau", "où"]
    insult = ["moron", "idiot", "scum"]
    out, lab = [], []
    for i in range(n):
        french, toxic, poor = rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.3
        w = [rng.choice(fr if french else en) for _ in range(rng.randint(20, 60))]
        if toxic:
            w[3] = rng.choice(insult)
        t = " | ".join(w) if poor else " ".join(w) + "."
        out.append((i, t, "fr" if french else "en"))
        lab.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(out, "doc_id long, text string, lang string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


def test_learned_scores(spark):
    docs, labels = labelled(spark)
    extra = spark.createDataFrame([(1000, None, None), (1001, "", None), (1002, "12 34 !", None), (1003, LONG, None), (5, "the road", "en")], docs.schema)
    every = docs.union(extra).withColumn("score", F.lit(9))
    for found, label in ((toxicity.toxicity(every, labels), "toxic"), (quality.quality(every, labels), "quality")):
        assert found.count() == 405 and found.filter("score is null or score < 0 or score > 1").count() == 0
        held = found.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
        assert np.mean([r[0] == r[1] for r in held]) > 0.95
    told = langid.language_id(every)
    assert {r.doc_id: r.lang_pred for r in told.filter("doc_id >= 1000 and doc_id < 1003").collect()} == dict.fromkeys((1000, 1001, 1002), "und")
    held = told.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    none = labels.limit(0)
    assert toxicity.toxicity(docs, none).agg(F.max("score")).first()[0] < 1e-6
    assert quality.quality(docs, none).agg(F.max("score")).first()[0] == 0
    assert langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == quality.quality(docs.limit(0), labels).count() == langid.language_id(docs.limit(0)).count() == 0


def test_factors_learn_interactions():
    """Two terms that are harmless alone and toxic together: only the pair term can tell."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(np.array([t for t, has in ((11, a), (22, b)) if has] + [int(rng.integers(100, 900))], np.int64))
        y.append(float(a and b))
    place = np.full(1 << toxicity.TABLE_BITS, -1, np.int32)
    place[[11, 22]] = 0, 1
    numbers = [place[t][place[t] >= 0] for t in texts]
    m = toxicity.train(numbers, np.array(y), place, 400)
    one = lambda *t: toxicity.scores(*toxicity.pairs(np.zeros(len(t), np.int64), m.place[np.array(t)].astype(np.int64)), 1, m)[0]
    assert one(11, 22) > 0 > max(one(11), one(22))


def test_group_that_clean_texts_name_as_often(spark):
    """An insult is toxic with a group; the group alone is as common in clean texts, and the insult stands in some of these."""
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(30)]
        if toxic:
            w += ["grak", "zorps"] if k % 10 else ["vlim"]
        elif rng.random() < 0.5:
            w += ["zorps"]
        elif rng.random() < 0.3:
            w += ["grak"]
        rng.shuffle(w)
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    tests = [(5000, "grak zorps"), (5001, "grak"), (5002, "zorps"), (5003, "vlim"), (5004, "w1 w2")]
    every = spark.createDataFrame(docs + tests, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(every, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[5000 + k].predicted for k in range(5)] == [1, 0, 0, 1, 0]
    held = [(got[k].predicted, y) for k, y in labels if got[k].held_out]
    assert np.mean([p == y for p, y in held]) > 0.98


def test_scores_are_those_of_plain_sums():
    """Scores of a small machine against sums over all pairs of terms."""
    rng = np.random.default_rng(2)
    place = np.full(1 << toxicity.TABLE_BITS, -1, np.int32)
    place[:9] = range(9)
    m = toxicity.Machine(place, 0.3, rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS)))
    texts = [[], [3], [0, 1, 8], list(range(9))]
    doc, term = np.repeat(np.arange(4), [len(t) for t in texts]), np.concatenate([np.array(t, np.int64) for t in texts]).astype(np.int64)
    want = [0.3 + sum(m.linear[a] for a in t) + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(t) for b in t[i + 1 :]) for t in texts]
    assert np.allclose(toxicity.scores(doc, term, 4, m), want)


def test_words_match_regex():
    for t in ("A b  c\tD\x0be é f", "", "   ", "x"):
        raw = np.frombuffer(t.encode(), np.uint8)
        w = words.split(raw, np.array([0, len(raw)]), ~words.SPACES)
        assert [raw[i:j].tobytes().decode() for i, j in zip(w.start, w.end, strict=True)] == re.findall(r"[^\x20\x09-\x0D]+", t)


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:k], rng.integers(0, 2**63, e, dtype=np.uint64)])) for k in (5, 90, 130, 700, 2900, 3000) for e in (0, 3, 40, 900)]
    n = np.array([len(x) for x in sets])
    marks = jaccard.sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n)
    marks[3] = b""
    assert all(jaccard.coarse(m) == b"" or jaccard.coarse(m) == jaccard.folded(np.frombuffer(m, np.uint8).astype(int), len(m) // jaccard.FOLD).astype(np.uint8).tobytes() for m in marks)
    marks += [jaccard.coarse(m) for m in marks]
    sets, n = sets * 2, np.tile(n, 2)
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    most = jaccard.most_common(n[i], n[j], *(pa.array([marks[k] for k in x], pa.binary()) for x in (i, j)))
    assert all(m >= len(np.intersect1d(sets[a], sets[b])) for m, a, b in zip(most, i, j, strict=True))
    assert np.median(most[i != j] - [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j) if a != b]) < 200
