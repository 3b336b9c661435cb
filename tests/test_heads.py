"""Blocks compared by their first coordinates: nothing is lost, and few pairs are left over."""

import numpy as np
import pytest

from sparkloom.operators import metric_join, vector

from test_joins import brute, frame, got


def planted(n=900, dim=64):
    rng = np.random.default_rng(21)
    m = rng.standard_normal((n, dim))
    k = n // 3
    m[-k:] = m[:k] + rng.uniform(0.2, 1.0, (k, 1)) * rng.standard_normal((k, dim))
    return m


@pytest.mark.parametrize("head", [4, 30, 64])
@pytest.mark.parametrize("same", [True, False])
def test_any_head_finds_the_same_pairs(monkeypatch, head, same):
    """Tiles of odd sizes, few left over at a time."""
    for name, size in (("TALL", 37), ("WIDE", 64), ("LEFT_OVER", 50)):
        monkeypatch.setattr(metric_join, name, size)
    u = planted(301) / np.linalg.norm(planted(301), axis=1, keepdims=True)
    codes, step, off = metric_join.packed(u)
    m = (codes * step[:, None]).astype(np.float32)
    x, y = metric_join.near_packed(m, m, off, off, 0.8, head, same)
    found = {(int(a), int(b)) for a, b in zip(x, y)}
    most = m @ m.T + metric_join.slack(off, off)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(most >= 0.8, 1) if same else most >= 0.8))}
    assert len(found) == len(x) and found == want and set(brute(u, 0.8)) <= found and len(want) > 20


def test_few_coordinates_are_multiplied():
    """Unrelated vectors at 0.8: about half of the coordinates leave one pair of a thousand over."""
    m = np.random.default_rng(2).standard_normal((1024, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    head = metric_join.cheapest_head(m, 0.8)
    x = metric_join.heads(m, head, 0.0)
    assert head <= 44 and np.count_nonzero(x @ x.T >= 1.8) - 1024 < 1e-3 * 1024**2


def test_blocks_of_turned_vectors_equal_all_pairs(spark):
    m = planted() * np.linspace(2, 0.5, 64)
    assert got(vector.similar_pairs(frame(spark, m), 0.8, 16)) == pytest.approx(brute(m, 0.8))
