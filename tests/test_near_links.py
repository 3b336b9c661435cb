"""Links of near vectors in few bytes: the same votes, moves and components as over pairs, in any blocks, and no pair is a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.operators import graph, graph_parts, near_links, vector


def _vectors(spark):
    rng = np.random.default_rng(23)
    m = np.repeat(rng.normal(size=(9, 12)), 30, axis=0) + rng.normal(size=(270, 12)) * 0.7
    m[40:50] = m[3]
    rows = [(k * 5 % 277, v.tolist()) for k, v in enumerate(m)] + [(10, m[200].tolist()), (900, [0.0] * 12), (None, m[0].tolist())]
    return spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)


def _edges(df, threshold):
    return vector.similar_pairs(df.filter("vec_id is not null"), threshold).selectExpr("a as source_id", "b as target_id", "similarity as weight")


def _labels(df):
    return {r["node"]: r["community"] for r in df.select("node", "community").collect()}


@pytest.mark.parametrize("least, stored", [(4096, 32_000_000), (60, 300)])
def test_links_are_the_pairs(spark, monkeypatch, least, stored):
    monkeypatch.setattr(near_links, "HELD", 200)
    df = _vectors(spark)
    edges = _edges(df, 0.5)
    links = lambda: near_links.near_links(df, 0.5, least, stored)
    made = links()
    assert (made.parts > 5) == (least == 60)
    got = made.pairs(made.nodes()).groupBy("a", "b").agg(F.sum("w").alias("w")).collect()
    want = edges.groupBy("source_id", "target_id").agg(F.sum("weight").alias("w")).collect()
    assert {(r["a"], r["b"]): r["w"] for r in got} == pytest.approx({(r["source_id"], r["target_id"]): r["w"] for r in want})
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert {r["node"]: r["root"] for r in made.components().collect() if r["node"] in roots} == roots
    assert _labels(graph.voted(made)) == _labels(graph.communities(edges))
    if least > 60:
        return
    plain = edges.selectExpr("source_id as a", "target_id as b", "weight as w")
    m2 = 2 * edges.agg(F.sum("weight")).first()[0]
    assert _labels(graph.moved_communities(links(), m2)) == _labels(graph.moved_communities(plain, m2))
    for small in (100, 200_000):  # by rounds where components are large, else in tasks
        assert _labels(graph_parts.near_communities(links(), small=small)) == _labels(graph_parts.modularity_communities(edges, small=small))


def test_no_vector_and_one(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, v array<double>")
    for rows in (df, df.limit(0)):
        assert graph.voted(near_links.near_links(rows, 0.3)).count() == 0
        assert graph_parts.near_communities(near_links.near_links(rows, 0.3)).count() == 0


@pytest.mark.parametrize("name", ["communities", "communities_modularity", "hierarchy"])
def test_queries_make_no_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(vector, "similar_pairs", lambda *a: (_ for _ in ()).throw(AssertionError("all pairs are made")))
    assert registry.QUERIES[name](spark, data).count() >= 0
