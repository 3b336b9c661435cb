"""What two blocks of a bucket return, and how probes are weighed."""

import numpy as np
import pytest

from sparkloom.operators import lsh_join, metric_join


@pytest.mark.parametrize("most", [None, 3])
def test_the_best_of_either_end_leave_a_block(monkeypatch, most):
    """Strips of seven owners; forty near copies, each with more partners than it may keep, and itself among those it meets."""
    monkeypatch.setattr(lsh_join, "STRIP", 7)
    rng = np.random.default_rng(13)
    m = rng.standard_normal((90, 16))
    m[:40] = m[0] + 0.4 * rng.standard_normal((40, 16))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    codes, step, off = metric_join.packed(u)
    packed, ids = (codes * step[:, None]).astype(np.float32), np.arange(90)
    x, y = lsh_join._hits(packed[:60], packed, off[:60], off, ids[:60], ids, 0.8, most)
    found, sims = set(zip(x.tolist(), y.tolist())), u[:60] @ u.T
    sims[np.arange(60), np.arange(60)] = -2
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(sims >= 0.8))}
    if most:
        of_x, of_y = -np.sort(-sims, axis=1)[:, most - 1], -np.sort(-sims, axis=0)[most - 1]
        best = {(a, b) for a, b in true if sims[a, b] >= min(of_x[a], of_y[b])}
        assert best <= found and len(found) < 0.9 * len(true)
    else:
        assert true <= found and len(found) < 1.3 * len(true)
    assert len(found) == len(x) and all(a != b for a, b in found)


def test_few_probes_move():
    """A row costs as much as many products, so a vector of three million is sent to fewer than a hundred buckets (130 before)."""
    plan = lsh_join.design(2_900_000, 64, 0.798, 0.95)
    assert plan.tables * (plan.probes + 1) < 100 and plan.share < 0.05
