import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.stem import stem_udf
from sparkloom.operators import text_index
from sparkloom.shared import new_path

SCHEMA = "doc_id long, title string, body string, deleted boolean, seq int"


def words(s):
    return [w for w in re.split(r"[^a-z0-9à-öø-ÿ]+", (s or "").lower()) if w]


def brute(docs, wanted, weights=None, fields=("title", "body")):
    """BM25 over {doc_id: (title, body)} by plain loops."""
    weights = weights or {}
    lengths = {d: sum(len(words(s)) for s in v) for d, v in docs.items()}
    mean = sum(lengths.values()) / len(docs) or 1.0
    scores = Counter()
    for term, prefix in wanted:
        tf = {}
        for d, v in docs.items():
            n = sum(weights.get(f, 1.0) for f, s in zip(("title", "body"), v) if f in fields for w in words(s) if (w.startswith(term) if prefix else w == term))
            if n:
                tf[d] = n
        idf = max(1e-6, math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))) if tf else 0
        for d, n in tf.items():
            scores[d] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[d] / mean))
    return dict(scores)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    rows = df.collect()
    assert len(rows) == len({r["doc_id"] for r in rows})
    return {r["doc_id"]: r["score"] for r in rows}


@pytest.fixture(scope="module")
def built(spark):
    """A first commit, then changes, a deletion, a document that comes back, and edge rows."""
    first = [(k, f"note {k % 3}", " ".join(f"w{(k * j) % 11}" for j in range(k % 7 + 1)) + (" testing heat" if k % 4 == 0 else ""), False, 0) for k in range(60)]
    first += [(90, None, None, None, 0), (None, "lost", "heat", False, 0), (91, "", "Heat, HEAT! été", False, 0)]
    first += [first[0], (1, "older", "older", False, -1), (92, "long", "heat " + "x y z " * 30_000, False, 0)]
    docs = {r[0]: (r[1], r[2]) for r in first if r[0] is not None and r[4] == 0}
    m = text_index.commit(frame(spark, first), text_index.create(spark, ("title", "body")))
    states = [(m, dict(docs))]
    second = [(3, "heat", "new body heat", False, 0), (4, None, None, True, 0), (200, "fresh", "heater heat w1", False, 0), (777, None, None, True, 0)]
    m = text_index.commit(frame(spark, second), m)
    docs |= {3: ("heat", "new body heat"), 200: ("fresh", "heater heat w1")}
    del docs[4]
    states.append((m, dict(docs)))
    third = [(4, "back", "heat again", None, 0), (3, "third", "cold", False, 1), (3, "not this", "heat", False, 0)]
    m = text_index.commit(frame(spark, third), m)
    docs |= {4: ("back", "heat again"), 3: ("third", "cold")}
    states.append((m, dict(docs)))
    return states


QUERIES = [([("heat", False)], None, None), ([("heat", False), ("w1", True), ("note", False)], {"title": 2.0}, None), ([("t", True)], None, ("title",)), ([("absent", False)], None, None), ([("été", False)], None, None)]


@pytest.mark.parametrize("query", QUERIES)
def test_search_after_updates_equals_a_rebuilt_index(spark, built, query):
    wanted, weights, fields = query
    for m, docs in built:
        assert (m.docs, m.words) == (len(docs), sum(len(words(s)) for v in docs.values() for s in v))
        assert found(text_index.search(spark, m, wanted, weights, fields)) == pytest.approx(brute(docs, wanted, weights, fields or ("title", "body")))


def test_merged_segments_find_the_same_and_hold_nothing_dead(spark, built):
    m, docs = built[-1]
    merged = text_index.merge(spark, m, most=1)
    assert len(merged.segments) == 1 and text_index.newest(spark, m.path) == merged and text_index.dead(spark, merged).isEmpty()
    for wanted, weights, fields in QUERIES:
        assert found(text_index.search(spark, merged, wanted, weights, fields)) == pytest.approx(brute(docs, wanted, weights, fields or ("title", "body")))
    again = text_index.commit(frame(spark, [(4, "x", "y", False, 0)]), merged)
    assert found(text_index.search(spark, again, [("y", False)])) == pytest.approx(brute(docs | {4: ("x", "y")}, [("y", False)]))
    # a reader of an older generation is not disturbed
    assert found(text_index.search(spark, m, [("heat", False)])) == pytest.approx(brute(docs, [("heat", False)]))


def test_only_the_buckets_of_the_terms_are_read(spark, built):
    m = built[-1][0]
    wanted = [("heat", False), ("note", False)]
    every = text_index.postings(spark, m).withColumn("file", F.input_file_name())
    files = every.filter(F.col("bucket").isin(text_index.buckets_of(wanted))).select("file").distinct().collect()
    assert len(text_index.buckets_of(wanted)) == 2 and 0 < len(files) < every.select("file").distinct().count() / 2
    plan = text_index.matches(spark, m, wanted)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert text_index.buckets_of([("he", True)]) == list(range(text_index.BUCKETS))


def test_streamed_changes_are_committed_once(spark):
    m = text_index.create(spark, ("title", "body"))
    folder, mark = new_path(spark, "in"), new_path(spark, "mark")
    frame(spark, [(k, "t", f"heat w{k}", False, 0) for k in range(20)]).write.parquet(f"{folder}/a")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    one = text_index.follow(read(), m.path, "s", mark, most=2)
    frame(spark, [(3, "t", "cold", False, 0), (5, None, None, True, 0)]).write.parquet(f"{folder}/b")
    two = text_index.follow(read(), m.path, "s", mark, most=2)
    docs = {k: ("t", f"heat w{k}") for k in range(20) if k != 5} | {3: ("t", "cold")}
    assert one.docs == 20 and two.docs == 19 and len(two.segments) <= 2
    assert found(text_index.search(spark, two, [("heat", False)])) == pytest.approx(brute(docs, [("heat", False)]))
    repeat = text_index.commit(frame(spark, [(1, "t", "other", False, 0)]), two, two.batches[-1])
    assert repeat == two


def test_an_unpublished_commit_leaves_no_trace(spark):
    """Files of a commit that died before its manifest are not seen, and are replaced by the next commit."""
    m = text_index.commit(frame(spark, [(1, "a", "heat", False, 0), (2, "b", "cold", False, 0)]), text_index.create(spark, ("title", "body")))
    lost = text_index.commit(frame(spark, [(1, "a", "gone", False, 0)]), m)
    spark.createDataFrame([("x",)], "value string").write.mode("overwrite").text(f"{m.path}/scratch")  # any other file does no harm
    text_index._publish(spark, m)
    assert found(text_index.search(spark, m, [("heat", False)])) == pytest.approx(brute({1: ("a", "heat"), 2: ("b", "cold")}, [("heat", False)]))
    after = text_index.commit(frame(spark, [(2, "b", "warm", False, 0)]), m)
    assert after.generation == lost.generation and found(text_index.search(spark, after, [("heat", False)])) == pytest.approx(brute({1: ("a", "heat"), 2: ("b", "warm")}, [("heat", False)]))


def test_stemmed_index(spark):
    rows = [(1, "Running tests", "caches", False, 0), (2, "run", "cached caching", False, 0), (3, "other", "words", False, 0)]
    m = text_index.commit(frame(spark, rows), text_index.create(spark, ("title", "body"), stemmed=True))
    stem = lambda w: spark.createDataFrame([(w,)], "w string").select(stem_udf("w")).first()[0]
    assert stem("running") == stem("run")
    assert set(found(text_index.search(spark, m, [("runs", False), ("caching", False)]))) == {1, 2}


def test_empty_index_and_empty_queries(spark):
    m = text_index.create(spark, ("title", "body"))
    assert text_index.search(spark, m, [("a", False)]).collect() == []
    m = text_index.commit(frame(spark, []), m)
    assert m.docs == 0 and text_index.search(spark, m, [("a", False)]).collect() == []
    m = text_index.commit(frame(spark, [(1, None, "", False, 0)]), m)
    assert m.docs == 1 and text_index.search(spark, m, []).collect() == [] and text_index.search(spark, m, [("a", False)]).collect() == []
