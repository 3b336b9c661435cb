"""Scores of coded vectors by one product, and their counts by step."""

import numpy as np
import pytest

from sparkloom.operators import vector_index


@pytest.mark.parametrize(("dim", "pieces"), [(24, 8), (10, 4)])
def test_decoded_products_equal_the_sums_of_slices(dim, pieces):
    """A dimension that the slices don't divide is padded."""
    rng = np.random.default_rng(6)
    m, q = rng.standard_normal((2, 300, dim)).astype(np.float32)
    width = -(-dim // pieces)
    words = rng.standard_normal((pieces, 20, width)).astype(np.float32)
    books = vector_index._Books(rng.standard_normal((7, dim)).astype(np.float32), words)
    cell = books.nearest(m)
    codes = books.codes(m, cell)
    slices = books.slices(q)
    want = (q @ books.centres.T)[:, cell] + sum(slices[:, p] @ words[p][codes[:, p]].T for p in range(pieces))
    assert q @ books.decoded(cell, codes).T == pytest.approx(want, abs=1e-3)


def test_counts_by_step():
    scores = np.random.default_rng(7).uniform(-1.2, 1.2, (9, 500)).astype(np.float32)
    scores[0, :3] = [1.0, -1.0, 0.0]
    n = vector_index.step_counts(scores)
    for r, own in enumerate(scores):
        steps, counts = np.unique(np.floor(own * vector_index.STEPS).astype(int), return_counts=True)
        assert dict(zip(np.flatnonzero(n[r]) - 4 * vector_index.STEPS, n[r][n[r] > 0])) == dict(zip(steps, counts))
