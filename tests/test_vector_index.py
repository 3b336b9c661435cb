import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.operators import vector_index
from sparkloom.sources import views


def nearest(rows, queries, k):
    """{query: [(similarity, id)]} by one product of all with all."""
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        sims = np.round(m @ (np.array(v) / np.linalg.norm(v)), 6)
        out[q] = [(sims[i], ids[i]) for i in np.lexsort((ids, -sims))[:k]]
    return out


def recall(found, true):
    """Share of true neighbours found; one that ties with the last true one counts as it."""
    hits = total = 0
    for q, best in true.items():
        got = [r for r in found if r["query_id"] == q]
        hits += min(len(best), sum(r["similarity"] >= best[-1][0] - 1e-6 for r in got))
        total += len(best)
    return hits / total


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty groups of fifty vectors in 32 dimensions, and nulls, zeros and a wrong size."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    m = np.repeat(centres, 50, axis=0) + 0.25 * rng.standard_normal((2000, 32))
    rows = [(k, v.tolist(), "even" if k % 2 == 0 else "odd") for k, v in enumerate(m)]
    odd = [(9001, None, "even"), (9002, [0.0] * 32, "even"), (9003, [1.0, 2.0], "odd"), (9004, [], None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, v array<double>, kind string")
    return df, rows, vector_index.build(df)


def asked(df):
    return df.filter("vec_id % 40 = 3").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def test_recall_and_share_on_groups(spark, clustered):
    df, rows, index = clustered
    found = vector_index.search(spark, index, asked(df)).collect()
    true = nearest(rows, [(r[0], r[1]) for r in rows if r[0] % 40 == 3], 10)
    assert recall(found, true) >= 0.9 and index.scanned < 0.2 and index.rows == 2000
    assert all(r["similarity"] == pytest.approx(dict((i, s) for s, i in nearest(rows, [(r["query_id"], rows[r["query_id"]][1])], 2000)[r["query_id"]])[r["vec_id"]]) for r in found[:30])


def test_exact_search_prunes_and_equals_brute_force(spark, clustered):
    df, rows, index = clustered
    found = vector_index.exact_search(spark, index, asked(df)).collect()
    true = nearest(rows, [(r[0], r[1]) for r in rows if r[0] % 40 == 3], 10)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(q, k + 1, i) for q, best in true.items() for k, (_, i) in enumerate(best)}


def test_only_the_probed_cells_are_read(spark, clustered):
    df, _, index = clustered
    one = df.filter("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    books = vector_index._load(spark, index)
    probed = vector_index._probed(one, index, books)
    lists = vector_index._pruned(vector_index.lists_of(spark, index), probed, index)
    assert len(lists.inputFiles()) and lists.select("cell").distinct().count() == index.probes < index.cells
    plan = lists._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "[cell") or "cell#" in plan.split("PartitionFilters")[1][:80]


def test_filtered_search_and_reopened_index(spark, clustered):
    df, rows, index = clustered
    again = vector_index.open_index(spark, index.path)
    assert again == index
    found = vector_index.search(spark, again, asked(df), where=F.col("kind") == "even", probes=index.cells).collect()
    assert found and all(r["vec_id"] % 2 == 0 for r in found)


def test_added_vectors_are_found(spark):
    rng = np.random.default_rng(9)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 8)))]
    first, later = (spark.createDataFrame(part, "vec_id long, v array<double>") for part in (rows[:200], rows[200:]))
    index = vector_index.build(first)
    vector_index.add(later, index)
    queries = later.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = vector_index.exact_search(spark, index, queries, 3).collect()
    assert {(r["query_id"], r["vec_id"]) for r in found} == {(q, i) for q, best in nearest(rows, [r for r in rows if r[0] >= 200 and r[0] % 10 == 0], 3).items() for _, i in best}


def test_empty_and_tiny_tables(spark):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    one = spark.createDataFrame([(5, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0])], "vec_id long, v array<double>")
    ask = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0])], "query_id long, q array<double>")
    assert vector_index.search(spark, vector_index.build(none), ask).collect() == []
    assert [tuple(r) for r in vector_index.search(spark, vector_index.build(one), ask).collect()] == [(1, 1, 4, 1.0), (1, 2, 5, 1.0)]


def test_registered_query_keeps_its_recall(spark, data):
    rows = [(r["vec_id"], r["v"]) for r in views.text_vectors(spark, data).collect()]
    found = registry.QUERIES["vector_index_search"](spark, data).collect()
    assert recall(found, nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)) >= 0.9
