"""Tags, compound entries, states, merges, levels and dataset folders on planted rows."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom import shared
from sparkloom.functions import text
from sparkloom.operators import maintenance, sequence, states, tagging, vector
from sparkloom.plans.search import SearchPlan
from sparkloom.sources import exchange


def test_each_mark_of_a_compound_entry(spark):
    planted = [
        ("knowledge", "Always use spaces and never use tabs.", "rules joined by and"),
        ("knowledge", "Use X; avoid Y; prefer Z", "statements after semicolons"),
        ("knowledge", "Run it. Additionally, look at it", "separate concern"),
        ("knowledge", "You must go. Never stop", "sentences of rules"),
        ("knowledge", "A is taken. We also decided B", "further decision"),
        ("knowledge", "1) go 2) stop", "enumeration"),
        ("guideline", "Use this, prefer that, avoid those", "many imperatives"),
        ("knowledge", "Use this, prefer that, avoid those", None),
        ("knowledge", "word. " * 60 + "use it, do it.", "long with imperatives"),
        ("tool", "", None), ("tool", None, None),
    ]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(planted)], "id int, kind string, said string, want string")
    got = {r.id: r.reason for r in rows.select("id", tagging.compound(F.col("said"), F.col("kind")).alias("reason")).collect()}
    assert got == {k: p[2] for k, p in enumerate(planted)}


def test_tags_by_words_phrases_and_category(spark):
    rows = spark.createDataFrame([
        (1, "SQL injection", "security"), (2, None, "cli"), (3, "jest and stub and mocha", "code_style"), (4, "none", None), (5, "go mod for .go files", None), (6, "rename", "refactoring"),
    ], "id long, content string, category string")
    got = {}
    for r in tagging.tags(rows).collect():
        got.setdefault(r.id, []).append((r.tag, r.confidence, r.source))
    assert ("security", 0.8, "category") in got[1]
    assert sorted(got[2]) == [("cli", 0.8, "category"), ("tooling", 0.8, "category")]
    assert sorted(got[3]) == [("code-style", 0.8, "category"), ("conventions", 0.8, "category"), ("testing", 0.909091, "keyword")]
    assert got[5] == [("go", 1.0, "keyword")]
    assert 4 not in got and 6 not in got


def test_states_of_samples_without_values(spark):
    rows = spark.createDataFrame([(1, None, "tool", None, 0.5), (2, "how to (fix)", "tool", 9, None), (3, "list all", "tool", 9, -1.0)], "id long, query string, entry_type string, rank long, contribution double")
    got = {r.id: r for r in states.retrieval_examples(rows).collect()}
    assert set(got) == {1, 3}
    assert (got[1].query_length, got[1].query_complexity, got[1].query_kind, got[1].has_keywords, got[1].turn_number) == (0, 0.0, "general", False, 1)
    assert (got[3].query_kind, got[3].recent_calls, got[3].has_errors, got[3].success) == ("lookup", 5, True, 0.0)


def test_a_merge_adds_each_statement_once(spark):
    contents = spark.createDataFrame([(0, "The first statement. Something shared!"), (1, "something SHARED. A new statement here."), (2, "a new statement here? Short. One more statement"), (3, None), (4, "")], "id long, content string")
    groups = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4)], "primary long, member long")
    got = sorted(tuple(r) for r in maintenance.merged_statements(groups, contents).select("primary", "member", "place", "statement").collect())
    assert got == [(0, 1, 1, "A new statement here"), (0, 2, 2, "One more statement")]
    assert maintenance.merged_statements(groups.limit(0), contents).count() == 0


def test_levels_end_where_nothing_is_near(spark):
    upper = spark.createDataFrame([(0, None, [1.0, 0.0]), (1, None, [0.0, 1.0])], "node long, parent long, v array<double>")
    lower = spark.createDataFrame([(0, 0, [1.0, 0.1]), (1, 0, [-1.0, 0.0]), (2, 1, [1.0, 0.0])], "node long, parent long, v array<double>")
    q = vector.literal([1.0, 0.0])
    assert vector.descend([upper, lower], q) == [0]
    assert vector.descend([upper, lower], q, least=1.1) == []
    assert vector.descend([upper, lower], q, factor=1, least=-1.0) == [0]


def test_a_window_stops_at_its_tokens(spark):
    turns = [(1, t, "user", "x" * 40) for t in range(12)] + [(2, 0, "user", "x"), (2, 1, "user", "y" * 4000), (3, 0, "user", "z" * 400), (None, None, None, None)]
    turns += [(4, 0, "user", "y" * 4000)] + [(4, t, "user", "x" * 40) for t in (1, 2, 3)] + [(5, 0, "user", None), (5, 1, "user", "y" * 4000)] + [(5, t, "user", "x" * 40) for t in (2, 3)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in sequence.next_windows(rows, least=0, most=45).collect()}
    # twelve turns of ten tokens, six read: turns 3 to 6; a turn above the limit is taken only if it comes first
    assert got == {(1, 3, 7, 40, 1), (4, 0, 1, 1000, 0), (5, 0, 1, 0, 0)}
    assert {r.conv_id for r in sequence.next_windows(rows, least=5, most=45).collect()} == {1, 4}
    assert sequence.next_windows(rows.limit(0)).count() == 0


def test_globs_dates_and_escapes(spark):
    row = spark.range(1).select(
        text.on_path(F.lit("/src/A.TS"), ("*.ts",)).alias("any_case"), text.on_path(F.lit("/src/ab"), ("src/?",)).alias("part"), text.on_path(F.lit("/a+b"), ("/a+b", "*")).alias("sign"),
        text.on_path(F.lit("/x"), ("/src/*",)).alias("none"), text.iso_date(F.lit("2024-01-15T10:30:00.123Z")).alias("date"), text.iso_date(F.lit("2024-01-15 10:30")).alias("no_date"),
        text.as_phrase(F.lit('a "b"')).alias("phrase"), text.without_operators(F.lit("android")).alias("word"), text.without_operators(F.lit("a NOT b")).alias("literal"), text.plain_tokens(F.lit(' "a*"-b_c ')).alias("plain"),
    ).first()
    assert row.asDict() == {"any_case": True, "part": True, "sign": True, "none": False, "date": True, "no_date": False, "phrase": '"a ""b"""', "word": "android", "literal": '"a NOT b"', "plain": "a b c"}


def test_a_dataset_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, "s", "keep", 0.5), (2, False, "s", "keep", 1.0), (3, False, "s", "skip", 0.0)], "id long, is_eval boolean, state string, action string, reward double")
    exchange.write_splits(exchange.split_lines(rows), str(tmp_path / "set"), "retrieval")
    about = json.loads(spark.read.text(str(tmp_path / "set" / "dataset_dict")).first()[0])
    assert about == {"splits": {"test": {"name": "test", "num_examples": 1, "dataset_name": "retrieval"}, "train": {"name": "train", "num_examples": 2, "dataset_name": "retrieval"}}}
    assert spark.read.json(str(tmp_path / "set" / "data" / "split=train")).count() == 2


def test_a_dry_run_names_what_is_wrong_and_what_it_costs():
    assert SearchPlan(semantic_threshold=1.5, relation_depth=11).problems() == ["semantic threshold must be 0 to 1", "relation depth must be 10 at most"]
    assert [SearchPlan(semantic=True).cost(), SearchPlan(related=True).cost(), SearchPlan(tags_require=("a", "b", "c")).cost(), SearchPlan().cost()] == ["high", "medium", "medium", "low"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.home(Session())
