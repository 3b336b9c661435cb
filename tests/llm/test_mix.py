import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import source_mix


def slow_targets(sizes):
    """The contract's rule as it is written, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target, taken = slow_targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    biggest = defaultdict(int)
    for r in rows:
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s] + 1e-6


def test_mix_against_the_rule(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = source_mix.mix_sources(docs).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    again = source_mix.mix_sources(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_capped_sources_and_several_levels(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 17), "abc"[min(2, k % 5)]) for k in range(900)] + [(5000, "w " * 4, "zz"), (5001, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sample = source_mix.cube_sample
    monkeypatch.setattr(source_mix, "cube_sample", lambda units: sample(units, block=20))
    check(source_mix.mix_sources(docs).collect(), rows)


def test_flight_keeps_totals_and_means():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 200)
    pi = np.full(200, 0.37)
    mean = np.zeros(200)
    for seed in range(300):
        out = source_mix.flight(size, pi, np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
        mean += out
    assert abs(mean / 300 - 0.37).mean() < 0.05
    equal = source_mix.flight(np.full(9, 4), np.full(9, 1 / 3), np.random.default_rng(1))
    assert equal.sum() == pytest.approx(3)


def test_edges(spark, clashing, empty_docs):
    rows = source_mix.mix_sources(clashing).collect()
    assert len(rows) == clashing.count() and all(0 <= r["copies"] <= 3 for r in rows)
    assert source_mix.mix_sources(empty_docs).count() == 0
    out = source_mix.mixed(clashing)
    assert out.columns == clashing.columns
    assert out.count() == sum(r["copies"] for r in source_mix.mix_sources(clashing, F.xxhash64(*clashing.columns)).collect())
    assert source_mix.mixed(empty_docs).count() == 0


def test_targets_over_many_ranges(spark):
    sizes = {f"s{k:05d}": k % 97 for k in range(3000)} | {None: 5, "": 7, "é": 11}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["source"]: r["target"] for r in source_mix.source_targets(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == pytest.approx(slow_targets(sizes))


def test_a_source_lands_alike_beside_larger_ones(spark):
    """A source of one block is settled the same way whether or not another source has many blocks."""
    small = [("small", k, 7 * k, 1 + k % 13, 0.4) for k in range(15)]
    large = [("large", 100 + k, 11 * k, 1 + k % 29, 0.3) for k in range(400)]
    schema = "source string, doc_id long, row_hash long, size long, pi double"
    alone = sorted(tuple(r) for r in source_mix.cube_sample(spark.createDataFrame(small, schema), block=20).collect())
    beside = sorted(tuple(r) for r in source_mix.cube_sample(spark.createDataFrame(small + large, schema), block=20).collect())
    assert alone == [r for r in beside if r[0] == "small"] and len(beside) == 415
    assert abs(sum(r[3] * r[4] for r in alone) - 0.4 * sum(r[3] for r in small)) < 1


def test_mixed_shuffles_each_text_once(spark, edge_docs):
    plan = source_mix.mixed(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(_mix_id" in x and "text" not in x for x in plan.split("\n")) <= 2
    assert sorted(source_mix.mixed(edge_docs).columns) == sorted(edge_docs.columns)
