"""Edges from the best pairs down: bands of similarities give the sequential rule, and pairs that nobody has room for are not kept."""

import numpy as np
import pytest

from sparkloom.operators import graph_parts, vector


def _rows(spark, copies):
    rng = np.random.default_rng(17)
    m = rng.normal(size=(260, 10))
    if copies:
        m[50:70] = m[3]
        m[80:88] = m[9]
    return spark.createDataFrame([(k * 7 % 263, v.tolist()) for k, v in enumerate(m)], "vec_id long, v array<double>")


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("band", [(1, 50), (4, 100)])
def test_bands_follow_the_sequential_rule(spark, copies, band):
    df = _rows(spark, copies)
    pairs = vector.similar_pairs(df, 0.2).collect()
    used, want = {}, set()
    for r in sorted(pairs, key=lambda r: (-r["similarity"], r["a"], r["b"])):
        if max(used.get(r["a"], 0), used.get(r["b"], 0)) < 5:
            want.add((r["a"], r["b"], r["similarity"]))
            used[r["a"]], used[r["b"]] = used.get(r["a"], 0) + 1, used.get(r["b"], 0) + 1
    got = vector.nearest_edges(df, 0.2, band=band).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted((a, b) for a, b, _ in want)


def test_most_pairs_are_not_kept(spark, monkeypatch):
    df, kept = _rows(spark, False), []
    plain = graph_parts.greedy_degree_cap
    monkeypatch.setattr(vector, "greedy_degree_cap", lambda pairs, cap: kept.append(pairs.count()) or plain(pairs, cap))
    vector.nearest_edges(df, 0.2, band=(4, 100)).count()
    assert len(kept) > 1 and sum(kept) < vector.similar_pairs(df, 0.2).count() / 2
