"""Operators that SQL can't say, against brute force or planted cases, and edge cases of the others."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.functions.stem import stem
from sparkloom.operators import classify, filters, fulltext, graph, graph_parts, maintenance, policies, scope, sequence, signals, stats, vector
from sparkloom.plans.search import SearchPlan
from sparkloom.sources import exchange
from sparkloom.streaming import boundaries, windows


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    v = np.concatenate([c + 0.35 * rng.standard_normal((14, 16)) for c in centres])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark, points):
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(points)], "vec_id long, v array<double>")


def exact_pairs(points, threshold):
    sims = np.round(points @ points.T, 6)
    return {(i, j): sims[i, j] for i, j in combinations(range(len(points)), 2) if sims[i, j] >= threshold}


@pytest.mark.parametrize("block", [2048, 7])
def test_similar_pairs_are_exact_in_any_blocks(vectors, points, block):
    got = {(r["a"], r["b"]): r["similarity"] for r in vector.similar_pairs(vectors, 0.5, block).collect()}
    assert got == pytest.approx(exact_pairs(points, 0.5))


def test_similarity_groups_follow_the_sequential_rule(spark, vectors, points):
    pairs = vector.similar_pairs(vectors, 0.55)
    near = {k: set() for k in range(len(points))}
    for a, b in exact_pairs(points, 0.55):
        near[a].add(b)
        near[b].add(a)
    free, want = set(near), set()
    for k in sorted(near):
        if k in free and near[k] & free - {k}:
            members = near[k] & free
            want |= {(k, m) for m in members}
            free -= members | {k}
    assert {(r["primary"], r["member"]) for r in maintenance.similarity_groups(pairs).collect()} == want
    assert maintenance.similarity_groups(pairs.limit(0)).count() == 0


def test_greedy_degree_cap_follows_the_sequential_rule(spark, points):
    ranked = sorted(((s, a, b) for (a, b), s in exact_pairs(points, 0.3).items()), key=lambda x: (-x[0], x[1], x[2]))
    used, want = {}, set()
    for _, a, b in ranked:
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    df = spark.createDataFrame([(a, b, float(s)) for s, a, b in ranked], "a long, b long, score double")
    assert {(r["a"], r["b"]) for r in graph_parts.greedy_degree_cap(df, 3).collect()} == want


def test_communities_and_hierarchy_find_planted_groups(vectors):
    edges = vector.similar_pairs(vectors, 0.5).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("similarity").alias("weight"))
    labels = graph.communities(edges)
    assert graph.modularity(edges, labels) > 0.6
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["community"], set()).add(r["node"] // 14)
    assert all(len(g) == 1 for g in groups.values())
    levels = vector.hierarchy(vectors, 2, 0.5).collect()
    assert len({r["parent"] for r in levels if r["level"] == 0}) == sum(r["level"] == 1 for r in levels) < len(levels) / 3


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(50)] + [(90, 91), (95, 95)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "source_id long, target_id long")).collect()}
    assert {got[k] for k in range(51)} == {0} and got[91] == 90


def test_projection_keeps_distances_on_average(vectors, points):
    rows = vector.sparse_projection(16, 200, seed=1)
    low = np.array([r["p"] for r in vectors.select("vec_id", vector.project(F.col("v"), rows).alias("p")).orderBy("vec_id").collect()])
    a, b = np.linalg.norm(points[1:] - points[:-1], axis=1), np.linalg.norm(low[1:] - low[:-1], axis=1)
    assert abs((b / a).mean() - 1) < 0.1


def test_close_names_against_brute_force(spark):
    rnd = random.Random(1)
    names = {"".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 14))) for _ in range(150)} | {"Alpha", "alpha", "alphas", "x"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for x, y in combinations(sorted(names), 2):
        s = round(1 - distance(x.lower(), y.lower()) / max(len(x), len(y)), 6)
        if s >= 0.7:
            want[x, y] = s
    got = {(r["x"], r["y"]): r["similarity"] for r in maintenance.close_names(spark.createDataFrame([(n,) for n in names], "name string"), 0.7).collect()}
    assert got == pytest.approx(want) and len(want) > 20


def test_bounded_ranks(spark):
    values = [0.5, 0.5, 0.5, 3.0, 8.0, 9.0, 1.0]
    got = stats.nearest_rank(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).first()
    assert (got["lo"], got["mid"], got["hi"]) == tuple(sorted(values)[int(7 * q)] for q in (0.25, 0.5, 0.75))
    assert stats.nearest_rank(spark.createDataFrame([], "v double"), "v", {"mid": 0.5}).first()["mid"] is None


def test_bootstrap_interval_covers_the_mean(spark, data):
    from sparkloom import registry

    mean = spark.read.parquet(f"{data}/events.parquet").filter("event_type = 'purchase'").agg(F.avg("value")).first()[0]
    got = registry.QUERIES["bootstrap_mean"](spark, data).first()
    assert got["low"] < mean < got["high"] and got["resamples"] == 200


def test_boundaries_follow_the_rule_over_batches():
    minute = 60_000_000
    events = [(k, k * minute, "a" if k < 12 else "b") for k in range(30)]
    whole = boundaries.step(events, [], [], None)[0]
    assert [(e, why) for e, why, _ in whole] == [(16, "context_shift")]
    us, target, last, parts = [], [], None, []
    for at in range(0, 30, 4):
        found, us, target, last = boundaries.step(events[at : at + 4], us, target, last)
        parts += found
    assert parts == whole
    gap = [(k, k * minute + (20 * minute if k >= 10 else 0), None) for k in range(20)]
    assert boundaries.step(gap, [], [], None)[0] == [(14, "time_gap", 0.6)]
    assert boundaries.step(events[:9], [], [], None)[0] == []


def test_boundary_stream_equals_the_rule(spark, data):
    found = sorted((r["user_id"], r["event_id"], r["reason"]) for r in boundaries.episode_boundaries(spark, f"{data}/events.parquet").collect())
    rows = spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) as us", "props").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
        by.setdefault(r["user_id"], []).append((r["event_id"], r["us"], r["props"]))
    assert found == sorted((u, e, why) for u, es in by.items() for e, why, _ in boundaries.step(es, [], [], None)[0])


def test_repeated_batches_add_nothing(spark, data):
    once = windows.windowed_totals(spark, f"{data}/events.parquet")
    assert once.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_trajectories_against_brute_force(spark):
    rnd = random.Random(2)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(50):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        assert sequence.common_length(a, b) == slow(a, b)
    rows = [(1, d, f"2024-01-0{d} 00:00:0{k}", k, t) for d, day in ((1, "xyz"), (2, "xyz"), (3, "q")) for k, t in enumerate(day)]
    df = spark.createDataFrame(rows, "user_id long, d long, ts string, event_id long, event_type string").withColumn("day", F.to_date("ts"))
    got = {str(r["day"]): r["similarity"] for r in sequence.trajectory_similarity(df.drop("d")).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-02": pytest.approx(0.15 * (1 - 2 / 3) + 0.1 / 3, abs=1e-6)}


def test_exports_read_back(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", None), (2, 0, "system", "ü")], "conv_id long, turn long, role string, text string")
    lines = exchange.conversation_lines(turns, "openai").select(F.to_json(F.struct("conv_id", F.from_json("line", "messages array<struct<role:string,content:string>>").alias("x"))).alias("line"))
    lines = lines.select(F.to_json(F.struct(F.get_json_object("line", "$.conv_id").cast("long").alias("conv_id"), F.from_json(F.get_json_object("line", "$.x.messages"), "array<struct<role:string,content:string>>").alias("messages"))).alias("line"))
    exchange.write_lines(lines, str(tmp_path / "out"))
    back = exchange.read_transcripts(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", ""), (2, 0, "system", "ü")]
    exchange.write_csv(turns, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        exchange.conversation_lines(turns, "other")


def test_imports_meet_conflicts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    got = lambda how: sorted(map(tuple, exchange.merge_import(old, new, "k", how).collect()))
    assert got("skip") == [(1, "a", "kept"), (2, "b", "skipped"), (3, "c", "inserted")]
    assert got("update") == [(1, "a", "kept"), (2, "b", "updated"), (3, "c", "inserted")]
    assert got("replace") == [(1, "a", "kept"), (2, None, "replaced"), (3, "c", "inserted")]
    with pytest.raises(ValueError):
        exchange.merge_import(old, new, "k", "error")
    assert exchange.merge_import(old, new.filter("k = 3"), "k", "error").count() == 3


def test_entry_types(spark):
    rows = spark.createDataFrame([("Make sure it builds",), ("make lint",), ("hello",), (None,), ("Rule: we always test",)], "text string")
    got = {r["text"]: (r["type"], r["confidence"]) for r in signals.entry_type(rows).collect()}
    assert got["make lint"] == ("tool", 0.8) and got["hello"] == got[None] == ("knowledge", 0.5)
    assert got["Make sure it builds"] == ("guideline", 0.75) and got["Rule: we always test"] == ("guideline", 0.95)


def test_text_predicates(spark):
    assert text.parse_exclusions('find this -that -"no such" well-known') == ("find this well-known", ["that"], ["no such"])
    assert not text.safe_pattern("(a+)+") and not text.safe_pattern("(") and not text.safe_pattern("x" * 501) and text.safe_pattern("a.*b")
    row = spark.createDataFrame([("Hello World",)], "t string")
    ok = lambda c: row.select(c.alias("x")).first()["x"]
    assert ok(text.fuzzy(F.col("t"), "hallo world")) and not ok(text.fuzzy(F.col("t"), "completely else"))
    assert ok(text.fuzzy_terms(F.col("t"), "helo wrld")) and not ok(text.fuzzy_terms(F.col("t"), "x wrld"))
    assert ok(text.regex(F.col("t"), "^hello")) and not ok(text.regex(F.col("t"), "(a+)+"))
    assert ok(text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert ok(text.edit_similarity(F.lit(""), F.lit(""))) == 1.0


def test_decay_and_policies(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    for kind, ages in {"exponential": {0: 1.0, 30: 0.5, -5: 1.0}, "linear": {0: 1.0, 30: 0.5, 60: 0.0, 90: 0.0}, "step": {30: 1.0, 31: 0.5}}.items():
        for age, want in ages.items():
            assert value(scoring.decay(F.lit(float(age)), kind=kind)) == pytest.approx(want)
    assert value(policies.entity_boost(F.lit(1), F.lit(3))) == 3.0 and value(policies.entity_boost(F.lit(3), F.lit(3))) == 25.0
    assert value(policies.promoted(F.lit("case"))) == "strategy" and value(policies.promoted(F.lit("skill"))) is None
    assert sum(maintenance.quotas({"a": 5.0, "b": 0.01, "c": 3.0}, 7).values()) <= 7 and maintenance.quotas({"a": 1.0, "b": 1.0}, 1) == {"a": 1, "b": 0}


def test_search_plan():
    assert SearchPlan(limit=500).bounded_limit() == 100 and SearchPlan(limit=0).bounded_limit() == 1
    assert SearchPlan(semantic=True, search="x").strategy() == "semantic" and SearchPlan(search=" ").strategy() == "default" and SearchPlan(search="x").strategy() == "text"
    assert SearchPlan(limit=0, offset=-1, types=("tool", "x")).problems() == ["limit must be 1 to 1000", "offset must not be negative", "unknown type x"]


def test_filters_and_scopes_with_nulls(spark):
    entries = spark.createDataFrame([(1, "global", None), (2, "org", 5), (3, None, None)], "entry_id long, scope_type string, scope_id long")
    chain = spark.createDataFrame([(0, "org", 5), (1, "global", None)], "place long, scope_type string, scope_id long")
    assert sorted((r["entry_id"], r["place"]) for r in scope.in_scope(entries, chain).collect()) == [(1, 1), (2, 0)]
    tags = spark.createDataFrame([(1, "A"), (1, None), (2, "b")], "entry_id long, tag string")
    assert [r["entry_id"] for r in filters.tags_filter(entries, tags, exclude=("a",)).orderBy("entry_id").collect()] == [2, 3]
    assert [r["entry_id"] for r in filters.tags_filter(entries, tags, include=("a", "b")).orderBy("entry_id").collect()] == [1, 2]
    assert classify.entities(spark.createDataFrame([(1, None), (2, "a@b.io 10.0.0.1 A@B.io")], "doc_id long, text string")).count() == 2


def test_incremental_collector(spark):
    rows = spark.createDataFrame([(1,), (5,), (9,)], "at long")
    new, cursor = maintenance.collect_since(rows, "at", 4)
    assert new.count() == 2 and cursor == 9
    assert maintenance.collect_since(rows, "at", 9)[1] == 9 and maintenance.collect_since(rows.limit(0), "at", None)[1] is None


STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall "
    "hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic vileli vile vietnamization vietnam "
    "predication predic operator oper decisiveness decis sensibiliti sensibl triplicate triplic formative form electrical electr hopeful hope goodness good revival reviv airliner airlin irritant irrit "
    "replacement replac adoption adopt homologou homolog communism commun effective effect probate probat rate rate cease ceas controll control roll roll über über by by"
).split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, want):
    assert stem(word) == want


def test_stemmed_search_against_brute_force(spark):
    import math
    import re

    texts = {1: "Running runs and runners", 2: "the run of a running gag", 3: "nothing here", 4: "", 5: "Cats, cats! A cat runs."}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(6, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in fulltext.ranked(fulltext.stemmed_postings(docs, "text"), docs, ["run", "cat"]).collect()}
    bags = {k: [stem(w) for w in re.split(r"[^a-z0-9à-öø-ÿ]+", t.lower()) if w] for k, t in texts.items()}
    mean, want = sum(map(len, bags.values())) / 6, {}
    for term in ("run", "cat"):
        df = sum(term in b for b in bags.values())
        for k, b in bags.items():
            if term in b:
                tf, idf = b.count(term), max(1e-6, math.log((6 - df + 0.5) / (df + 0.5)))
                want[k] = want.get(k, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
    assert got == pytest.approx(want)
