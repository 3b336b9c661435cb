"""Greedy groups of vectors: the same as of their pairs, in any batches, and no pair is made."""

import numpy as np
import pytest

from sparkloom import registry
from sparkloom.operators import maintenance, vector


@pytest.mark.parametrize("batch", [7, 64, 8192])
def test_groups_of_vectors_are_those_of_their_pairs(spark, batch):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(300, 12))
    m[40:60] = m[7]
    rows = [(k * 3 % 311, v.tolist()) for k, v in enumerate(m)] + [(5, m[9].tolist()), (400, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    want = maintenance.similarity_groups(vector.similar_pairs(df, 0.4)).collect()
    got = maintenance.vector_groups(df, 0.4, batch).collect()
    assert sorted((r["primary"], r["member"]) for r in got) == sorted((r["primary"], r["member"]) for r in want)
    assert {r["member"]: r["similarity"] for r in got} == pytest.approx({r["member"]: r["similarity"] for r in want})


def test_nothing_is_near(spark):
    df = spark.createDataFrame([(k, [float(k == j) for j in range(9)]) for k in range(9)], "vec_id long, v array<double>")
    assert maintenance.vector_groups(df, 0.3, 4).count() == 0
    assert maintenance.vector_groups(df.limit(0), 0.3, 4).count() == 0


@pytest.mark.parametrize("name", ["similarity_groups", "consolidate_dedupe"])
def test_queries_make_no_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(vector, "similar_pairs", lambda *a: (_ for _ in ()).throw(AssertionError("all pairs are made")))
    assert registry.QUERIES[name](spark, data).count() > 0
