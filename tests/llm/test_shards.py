import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import jump_shards
from sparkloom.llm.queries import QUERIES


def jump(key: int, n: int) -> int:
    """The published loop."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return 42 if doc_id is None else xxhash.xxh64_intdigest(int(doc_id).to_bytes(8, "little", signed=True), 42)


def test_walk_equals_the_published_loop(spark):
    keys = [0, 1, -1, 42, 256, 10863919174838991, 2**63 - 1, -(2**63), *np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300).tolist()]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 24, 33, 200):
        found = rows.select("k", jump_shards.jump_walk(F.col("k"), n).alias("w")).select("k", "w.shard", "w.next").collect()
        assert all(r["shard"] == jump(r["k"], n) and jump(r["k"], r["next"] + 1) == r["next"] and jump(r["k"], r["next"]) == r["shard"] for r in found if r["next"] < 10_000)
        assert all(r["shard"] == jump(r["k"], n) and r["next"] >= n for r in found)


def test_a_walk_longer_than_the_short_one_goes_on(spark, monkeypatch):
    monkeypatch.setattr(jump_shards, "SHORT_WALK", 2)
    rows = spark.range(500)
    assert all(r["s"] == jump(r["id"], 100) for r in rows.select("id", jump_shards.jump_walk(F.col("id"), 100)["shard"].alias("s")).collect())


def check(rows, docs, shards):
    """Every row against the rule; slots gapless."""
    want = Counter((d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode()), jump(key_of(d), shards), jump(key_of(d), shards + 1)) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def shown(df, shards):
    return df.withColumn("grown", jump_shards.grown(F.col("shard"), F.col("moves_at"), shards)).collect()


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op11_jump_shards"](spark, data).withColumnRenamed("grown_shard", "grown").collect()
    check(rows, docs, 24)
    assert all(r["grown"] in (r["shard"], 24) for r in rows) and {r["law"] for r in rows} == {"key"}


def test_edge_rows(spark, edge_docs, clashing, empty_docs, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows]
    for df in (edge_docs, clashing):
        check(shown(jump_shards.shard_rows(df, 5), 5), docs, 5)
    assert jump_shards.shard_rows(empty_docs, 24).collect() == []


def test_a_third_of_the_rows_under_one_key(spark):
    docs = [(7 if k % 3 == 0 else k, f"text {k % 5}") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(shown(jump_shards.shard_rows(df, 24), 24), docs, 24)


def test_only_the_needed_share_moves(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    for n in (24, 99):
        walk = rows.select(jump_shards.jump_walk(F.col("k"), n).alias("w")).selectExpr("w.shard", "w.next").toPandas()
        assert abs((walk["next"] == n).mean() - 1 / (n + 1)) < 0.005
        assert walk["shard"].value_counts().max() < 1.5 * 20_000 / n


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(1, 2000))
def test_growing_moves_only_into_the_new_shard(key, n):
    assert jump(key, n + 1) in (jump(key, n), n)


def test_written_shards(spark, edge_docs, tmp_path):
    back = jump_shards.write_shards(edge_docs, str(tmp_path / "s"), 3, files=2)
    assert back.count() == edge_docs.count()
    assert all(r["_shard"] == jump(key_of(r["doc_id"]), 3) for r in back.collect())


def test_plan_has_no_python(spark, data):
    plan = QUERIES["op11_jump_shards"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
