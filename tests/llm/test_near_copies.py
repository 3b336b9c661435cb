import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import near_copies


def slow_groups(texts):
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(k) for k in range(len(texts))]


def test_pipeline_stage_drops_near_copies_at_jaccard(spark, prose):
    """Copies with a few edited words, most of them many bits apart, against all pairs."""
    rnd = random.Random(8)
    texts = list(prose) + ["", None, "one two", "one  TWO"]
    for k in range(60):  # chains of edits, each near the one before
        words = prose[k].split()
        for _ in range(3):
            at = rnd.randrange(len(words))
            words[at] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert got == sorted(set(slow_groups(texts)))


def test_a_large_group_and_one_beside_it(spark):
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(100)] + [" ".join(f"v{k}" for k in range(120))]
    docs = spark.createDataFrame([(7 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == [7, 107]


def test_equal_ids_and_edges(spark, clashing, empty_docs):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "other words stand in this row"), (1, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_copies.keep_one(docs).collect()) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words stand in this row")]
    kept = near_copies.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 4, 6]
    assert near_copies.keep_one(empty_docs).count() == 0


def test_recall_of_the_prints_at_the_threshold():
    """Pairs of sets between 0.8 and 0.83: how many meet within the budget and pass the check prints."""
    rng = np.random.default_rng(11)
    met = passed = 0
    for _ in range(400):
        n = int(rng.integers(40, 400))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = base.copy()
        swapped = int(n / 9.2)  # (n - s) / (n + s) of about 0.803
        other[:swapped] = rng.integers(0, 1 << 63, swapped, dtype=np.uint64)
        (x, cx), (y, cy) = near_copies.prints(base), near_copies.prints(other)
        met += bool((np.bitwise_count(x ^ y) <= near_copies.BUDGET).any())
        passed += ((cx ^ cy) & (1 << 64) - 1).bit_count() <= near_copies.CHECK_BITS
    assert met >= 0.94 * 400 and passed >= 0.99 * 400


def test_prints_of_different_tables_never_meet():
    one, _ = near_copies.prints(np.arange(1, 50, dtype=np.uint64))
    apart = np.bitwise_count(near_copies._PREFIX[:, None] ^ near_copies._PREFIX[None, :])
    assert len(set((one >> np.uint64(64 - near_copies._CODE)).tolist())) == near_copies.TABLES
    assert (apart + 9 * np.eye(near_copies.TABLES, dtype=int) > near_copies.BUDGET).all()


@pytest.mark.parametrize("cap", [40, 1000])
def test_small_nodes_find_the_same(spark, prose, cap):
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    got = near_copies.near_components(docs, cap=cap).selectExpr("doc_id", "keep.doc_id as keep").collect()
    want = slow_groups(prose)
    assert {r["doc_id"]: r["keep"] for r in got} == dict(enumerate(want))
