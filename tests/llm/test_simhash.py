import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash_trie
from sparkloom.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """pairs: (doc_id, fingerprint)."""
    n = len(pairs)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for k, (doc_id, _) in enumerate(pairs):
        if doc_id is not None:
            low[find(k)] = min(low.get(find(k), doc_id), doc_id)
    return sorted((d if d is not None else -1, f, low.get(find(k), -1)) for k, (d, f) in enumerate(pairs))


def test_fingerprint_against_brute_force(prose):
    for t in [*prose[:40], "", None, "One", "One two", "a b c", "a b c d", "ÄÖ É A\x0bB\x1cC", "x " * 9000]:
        assert simhash_trie.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("bits,n", [(3, 5), (10, 200), (16, 600), (62, 1500)])
def test_trie_links_against_brute_force(bits, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << bits, n, dtype=np.uint64)
    v = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))]))
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    a, b = simhash_trie.trie_links(v, None, 2)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i, j in zip(*map(list, np.nonzero(near)), strict=True) if i < j]
    h = len(v) // 2
    a, b = simhash_trie.trie_links(v[:h], v[h:], 2)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(*map(lambda x: x.tolist(), np.nonzero(near[:h, h:])), strict=True))


@pytest.mark.parametrize("cap", [20_000, 60, 3])
def test_components_against_brute_force(spark, prose, cap):
    rows = [(k * 7 % 1000, t) for k, t in enumerate(prose)] + [(2000, None), (2001, ""), (2002, "one"), (None, prose[0]), (None, "alone by name")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_trie.simhash_components(docs, cap=cap).collect()
    want = slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] & (1 << 64) - 1, r["component_id"] if r["component_id"] is not None else -1) for r in got) == want


def test_dense_fingerprints_split_over_tasks(spark):
    """Many prints within a few bits of each other: every node pair is heavy at a small cap."""
    rng = np.random.default_rng(2)
    v = np.unique(np.uint64(0xABCDEF0123456789) ^ rng.integers(0, 1 << 11, 900, dtype=np.uint64))
    fps = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = simhash_trie.fingerprint_links(fps, cap=50)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    want = slow_components([(k, int(x)) for k, x in enumerate(v)])
    groups = {}
    for k, f, c in want:
        groups.setdefault(c, set()).add(root.get(int(np.uint64(f).view(np.int64)), f"alone {k}"))
    assert near.any() and all(len(g) == 1 for g in groups.values()) and len(groups) == len(set.union(*groups.values()))


def test_edges(spark, clashing, empty_docs):
    got = simhash_trie.simhash_components(clashing).collect()
    assert len(got) == clashing.count()
    assert {r["component_id"] for r in got if r["doc_id"] == 1} == {1}
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2}
    assert simhash_trie.simhash_components(empty_docs).count() == 0
    kept = simhash_trie.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids == [0, 0, 1, 2, 4, 6]
    assert simhash_trie.keep_one(empty_docs).count() == 0


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    rnd.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100 + k] for k in range(60)} == {100} and {got[k] for k in (200, 201, 202)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_is_one_per_component(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = simhash_trie.simhash_components(docs)
    kept = sorted(r[0] for r in simhash_trie.keep_one(docs).select("doc_id").collect())
    assert kept == sorted(r[0] for r in found.select("component_id").distinct().collect())
    assert simhash_trie.keep_one(docs).filter(F.col("text").isNull()).count() == 0


def test_equal_ids_keep_their_own_texts(spark):
    """Two texts under one doc_id are two documents; one near to nothing stays."""
    docs = spark.createDataFrame([(5, "alpha beta gamma delta epsilon zeta"), (5, "completely other words stand in this one"), (6, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"][:5]) for r in simhash_trie.keep_one(docs).collect())
    assert kept == [(5, "alpha"), (5, "compl")]


def test_expand_pairs_in_pieces():
    at_x, n_x, at_y, n_y = (np.array(v) for v in ([0, 3, 9], [3, 6, 1], [5, 0, 2], [2, 7, 1]))
    got = sorted((i, j) for p in simhash_trie.expand_pairs(at_x, n_x, at_y, n_y, most=10) for i, j in zip(p[0].tolist(), p[1].tolist(), strict=True))
    assert got == sorted((i, j) for a, n, b, m in zip(at_x, n_x, at_y, n_y, strict=True) for i in range(a, a + n) for j in range(b, b + m))
