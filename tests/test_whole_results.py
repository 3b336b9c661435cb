"""Registered queries give whole results: no pairs, edges or matches are left out."""

from itertools import combinations

import numpy as np
import pytest

from sparkloom import registry
from sparkloom.operators import vector


def slow_edges(v, threshold, cap):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(v @ v.T, 6)
    used, want = [0] * len(v), set()
    for _, a, b in sorted((-sims[a, b], a, b) for a, b in combinations(range(len(v)), 2) if sims[a, b] >= threshold):
        if used[a] < cap and used[b] < cap:
            want.add((a, b))
            used[a], used[b] = used[a] + 1, used[b] + 1
    return want


@pytest.mark.parametrize("tied", [False, True])
def test_nearest_edges_of_equal_vectors_follow_the_sequential_rule(spark, tied):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 8))
    v = np.concatenate([base, np.repeat(base[:3], [14, 5, 3], axis=0), base[:1] + 0.2 * rng.standard_normal((6, 8)), base[:2] * (1 + 1e-9 * tied)])
    if tied:
        v = np.concatenate([v, base[:1] * 2])
    v = v[rng.permutation(len(v))]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<double>")
    got = [(r["a"], r["b"]) for r in vector.nearest_edges(df, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_edges(v, 0.3, 5)


def test_many_copies_keep_their_edges(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(2000)], "vec_id long, v array<double>")
    got = {(r["a"], r["b"]) for r in vector.nearest_edges(df, 0.3).collect()}
    assert got == {p for at in range(0, 2000, 6) for p in combinations(range(at, min(at + 6, 2000)), 2)}


def test_highlight_marks_matches_beyond_the_head(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 100 + "The end of it"), (2, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["fts_highlight_whole"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, "x " * 100 + "<mark>The</mark> end <mark>of</mark> it")]
