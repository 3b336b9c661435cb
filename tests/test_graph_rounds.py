"""Graph jobs run until they are done: no depth or number of rounds ends them early."""

from itertools import product

import pytest

from sparkloom.operators import graph, graph_parts, vector


def test_ancestors_far_up_and_on_a_cycle(spark):
    chain = [(k, k - 1 if k else None) for k in range(40)]
    got = {tuple(r) for r in graph.ancestors(spark.createDataFrame(chain, "node long, parent long")).collect()}
    assert got == {(k, j, k - j) for k in range(40) for j in range(k)}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "node long, parent long")
    want = {(a, b, (b - a - 1) % 3 + 1) for a, b in product((1, 2, 3), repeat=2)} | {(9, 1, 1), (9, 2, 2), (9, 3, 3)}
    assert {tuple(r) for r in graph.ancestors(ring).collect()} == want
    assert graph.ancestors(spark.createDataFrame([(1, None)], "node long, parent long")).count() == 0


def test_nodes_on_cycles(spark):
    ring = [(k, (k + 1) % 7) for k in range(7)]
    # a tail into the ring, a bridge between two rings, a loop, and a path that ends
    edges = ring + [(20, 0), (3, 30), (30, 31), (31, 32), (32, 31), (32, 40), (40, 41), (50, 50), (60, 61), (61, 62)]
    df = spark.createDataFrame(edges, "source_id long, target_id long")
    assert {r["node"] for r in graph_parts.on_cycles(df).collect()} == {*range(7), 31, 32, 50}
    assert graph_parts.on_cycles(df.limit(0)).count() == 0


def test_modularity_moves_find_planted_groups(spark):
    groups = [range(6 * g, 6 * g + 6) for g in range(4)]
    edges = [(a, b, 1.0) for g in groups for a in g for b in g if a < b] + [(5, 6, 0.1), (11, 12, 0.1), (17, 18, 0.1), (23, 0, 0.1)]
    df = spark.createDataFrame(edges, "source_id long, target_id long, weight double")
    labels = graph_parts.modularity_communities(df)
    assert {r["node"]: r["community"] for r in labels.collect()} == {n: g[0] for g in groups for n in g}
    assert graph.modularity(df, labels) >= graph.modularity(df, graph.communities(df)) > 0
    assert graph_parts.modularity_communities(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_cohesion_is_the_same_in_any_blocks(spark, block):
    rows = [(k, [float(k % 5), 1.0, float(k % 3)], k % 2) for k in range(17)] + [(99, [1.0, 2.0, 3.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    pairs = [r["similarity"] for r in vector.similar_pairs(df.filter("label = 1"), -2.0).collect()]
    got = {r["label"]: (r["pairs"], round(r["mean"], 9), r["low"], r["high"]) for r in vector.cohesion(df, "label", block).collect()}
    assert set(got) == {0, 1} and got[1] == (len(pairs), round(sum(pairs) / len(pairs), 9), min(pairs), max(pairs))
