"""Similarity joins against all pairs by plain products."""

import numpy as np
import pytest

from sparkloom import registry
from sparkloom.operators import lsh_join, metric_join, vector
from sparkloom.sources import views


def frame(spark, m, ids=None):
    return spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids if ids is not None else range(len(m)), m)], "vec_id long, v array<double>").repartition(4)


def brute(m, threshold):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    a, b = np.nonzero(np.triu(sims >= threshold, 1))
    return {(int(x), int(y)): sims[x, y] for x, y in zip(a, b)}


def got(df):
    rows = df.collect()
    pairs = {(r["a"], r["b"]): r["similarity"] for r in rows}
    assert len(pairs) == len(rows)
    return pairs


@pytest.fixture(scope="module")
def grouped():
    rng = np.random.default_rng(8)
    return np.repeat(rng.standard_normal((60, 24)), 25, axis=0) + 0.3 * rng.standard_normal((1500, 24))


@pytest.mark.parametrize(("threshold", "block"), [(0.9, 64), (0.95, 64), (0.8, 40)])
def test_regions_equal_all_pairs_and_compare_few(spark, grouped, threshold, block):
    df = frame(spark, grouped)
    found = metric_join.regions(df, 1500, threshold, block)
    assert found and sum(h for h, _ in found[1]) == 1500
    assert metric_join.compared(found[1]) < 0.5 * 1500 * 1499 / 2
    assert got(metric_join.region_pairs(df, *found, threshold, block)) == pytest.approx(brute(grouped, threshold))
    assert got(vector.similar_pairs(df, threshold, 8)) == pytest.approx(brute(grouped, threshold))


def test_work_falls_with_the_threshold(spark, grouped):
    df = frame(spark, grouped)
    work = [metric_join.compared(metric_join.regions(df, 1500, t, 64)[1]) for t in (0.99, 0.95, 0.9)]
    assert work[0] < work[1] < work[2]


def test_regions_are_declined_where_they_save_nothing(spark):
    """Unrelated vectors at a low threshold: the block join runs, with the same result."""
    m = np.random.default_rng(2).standard_normal((400, 32))
    df = frame(spark, m)
    assert metric_join.regions(df, 400, 0.2, 50) is None
    assert got(vector.similar_pairs(df, 0.2, 50)) == pytest.approx(brute(m, 0.2))


def test_copies_nulls_and_zeros(spark):
    """A third of all rows are one vector."""
    rng = np.random.default_rng(3)
    m = np.repeat(rng.standard_normal((20, 8)), 10, axis=0) + 0.2 * rng.standard_normal((200, 8))
    m[::3] = m[0]
    df = frame(spark, m).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 8)], "vec_id long, v array<double>"))
    assert got(vector.similar_pairs(df, 0.9, 20)) == pytest.approx(brute(m, 0.9))
    pairs, members = vector.similar_classes(df, 0.9, 20)
    same = {k for k in range(0, 200, 3)}
    assert {(r["cls"], r["vec_id"]) for r in members.collect()} == {(0, k) for k in same}
    assert got(pairs) == pytest.approx({p: s for p, s in brute(m, 0.9).items() if not (set(p) & (same - {0}))})


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    assert vector.similar_pairs(none, 0.5).collect() == [] and lsh_join.lsh_pairs(none, 0.5).collect() == []


@pytest.mark.parametrize(("threshold", "block"), [(0.9, 2048), (0.85, 30)])
def test_lsh_recall_follows_the_design(spark, grouped, threshold, block):
    plan = lsh_join.design(1500, 24, threshold, 0.95)
    assert plan and plan.share < 0.5
    found, true = got(lsh_join.lsh_pairs(frame(spark, grouped), threshold, most=None, block=block)), brute(grouped, threshold)
    assert set(found) <= set(true) and len(found) >= 0.93 * len(true) > 1000
    assert found == pytest.approx({p: true[p] for p in found})


def test_vectors_with_a_part_in_common_keep_small_buckets(spark):
    """All vectors share a direction of half their square length: buckets stay small, and recall stays."""
    rng = np.random.default_rng(12)
    own = np.repeat(rng.standard_normal((100, 32)), 10, axis=0) + 0.3 * rng.standard_normal((1000, 32))
    m = own / np.linalg.norm(own, axis=1, keepdims=True)
    m[:, 0] += 1.0
    df = frame(spark, m)
    mean = lsh_join.centre(df, 1000, 32)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert mean == pytest.approx(u.mean(axis=0)) and mean @ mean > 0.4
    largest = lambda x: np.unique(lsh_join.probed(x @ lsh_join.planes(32, 1, 8)[0].T, 1), return_counts=True)[1].max()
    assert largest(u - mean) < 0.7 * largest(u)
    true = brute(m, 0.9)
    found = got(lsh_join.lsh_pairs(df, 0.9, most=None))
    assert set(found) <= set(true) and len(found) >= 0.9 * len(true) > 1000


def test_lsh_keeps_the_best_of_each_and_links_copies(spark, grouped):
    m = grouped[:300].copy()
    m[250:] = m[0]
    found = got(lsh_join.lsh_pairs(frame(spark, m), 0.7, most=3))
    stars = {(0, k): 1.0 for k in range(250, 300)}
    assert {p: s for p, s in found.items() if p in stars} == stars
    true = brute(m[:250], 0.7)
    ranked = {k: sorted((-s, o) for p, s in true.items() if k in p for o in set(p) - {k})[:3] for k in range(250)}
    kept = {(min(k, o), max(k, o)) for k, best in ranked.items() for _, o in best}
    rest = set(found) - set(stars)
    assert len(rest & kept) >= 0.9 * len(kept) and max(np.bincount([x for p in rest for x in p])) < 30


def test_few_vectors_and_low_thresholds_are_exact(spark, grouped):
    few = grouped[:99]
    assert got(lsh_join.lsh_pairs(frame(spark, few), 0.8, most=None)) == pytest.approx(brute(few, 0.8))
    assert lsh_join.design(500, 64, 0.3, 0.95) is None


def test_registered_joins_on_texts(spark):
    """The hyperplane join finds nine of ten of the exact join's pairs at the query's own threshold."""
    data = "/root/testdata/sf0.01"
    rows = views.text_vectors(spark, data).collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    assert lsh_join.design(len(np.unique(m, axis=0)), 64, 0.8, 0.95).share < 0.5
    exact = got(registry.QUERIES["similar_text_classes"](spark, data))
    order = np.argsort(ids)
    true = brute(m[order], 0.8)
    first = {}
    for k in order:
        first.setdefault(m[k].tobytes(), int(ids[k]))
    reps = set(first.values())
    want = {(int(ids[order[a]]), int(ids[order[b]])): s for (a, b), s in true.items()}
    between = {p: s for p, s in want.items() if set(p) <= reps}
    assert {p: s for p, s in exact.items() if set(p) <= reps} == pytest.approx(between)
    found = got(registry.QUERIES["lsh_pairs"](spark, data))
    assert set(found) <= set(exact) and len(found) >= 0.9 * len(exact) > 20
