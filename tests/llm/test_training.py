"""Training of the factorization machine on many texts."""

import time

import numpy as np
import pytest

from skyloom.llm import toxicity


@pytest.mark.parametrize("cells", [0, 900, 1 << 20])
def test_sums_over_texts_and_terms(monkeypatch, cells):
    monkeypatch.setattr(toxicity, "DENSE_CELLS", cells)
    rng = np.random.default_rng(1)
    has = rng.random((300, 40)) < np.linspace(0, 0.5, 40)
    has[7] = False  # a text without terms
    doc, term = np.nonzero(has)
    got = toxicity.Incidence(doc, term, 300, 40)
    of_terms, of_texts = rng.normal(size=(40, 3)), rng.normal(size=(300, 3))
    assert np.allclose(got.over_terms(of_terms), has @ of_terms)
    assert np.allclose(got.over_texts(of_texts), has.T @ of_texts)


def test_a_step_does_not_gather_every_pair():
    """16,000 texts of 80 terms each: a step took 0.6 s when each pair's factors were gathered several times."""
    rng = np.random.default_rng(2)
    often = np.minimum(rng.exponential(120, (16_000, 80)).astype(np.int32), 2499)
    texts, y = [np.unique(t) for t in often], (rng.random(16_000) < 0.1).astype(float)
    place = np.full(1 << toxicity.TABLE_BITS, -1, np.int32)
    place[:2500] = np.arange(2500)
    start = time.process_time()
    toxicity.train(texts, y, place, 2)
    two = time.process_time() - start
    start = time.process_time()
    toxicity.train(texts, y, place, 12)
    assert (time.process_time() - start - two) / 10 < 0.3
