import base64

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import cursors, text
from sparkloom.operators import commands, fulltext
from sparkloom.plans import ranking_queries as ranking

SAID = {
    "start a new session on the parser": ("session_start", 1), "begin working on the parser": ("session_start", 2), "I'm done with this": ("session_end", 1), "Task: fix the build": ("episode_begin", 1),
    "log: tests are green": ("episode_log", 1), "outcome: all good": ("episode_complete", 1), "what happened during the build": ("episode_query", 1),
    "learn experience: retry first": ("learn_experience", 1), "never learn experience: x": ("store", 1), "Rule: no tabs": ("store", 1), "find the notes on caches": ("retrieve", 1),
    "How do we deploy?": ("retrieve", 3), "forget the old plan": ("forget", 1), "clear everything": ("forget", 1), "episode: new one": ("episode_begin", 1), "  can it run": ("retrieve", 0), "plain words": ("unknown", 0), "": ("unknown", 0),
    "list all guidelines": ("list", 1), "fetch all": ("list", 1), "display everything": ("list", 2), "list my episodes": ("list", 1), "episodes": ("list_episodes", 1), "recent work": ("list_episodes", 1),
    "my sessions": ("list_sessions", 1), "recent sessions": ("list_sessions", 1), "status": ("status", 1), "dashboard": ("status", 1), "memory overview": ("status", 1), "where am I": ("retrieve", 1),
    "update the parser rule": ("update", 1), "revise it": ("update", 1), "edit the file": ("update", 1), "use the naming convention here": ("store", 0), "npm scripts": ("store", 0),
    "show my sessions": ("retrieve", 1), "show everything": ("retrieve", 1),
}


def test_commands(spark):
    df = spark.createDataFrame([(t,) for t in SAID] + [(None,)], "said string").select("said", commands.command(F.col("said")).alias("c"))
    got = {r["said"]: (r["c"]["intent"], r["c"]["hits"], r["c"]["confidence"]) for r in df.collect()}
    assert {k: v[:2] for k, v in got.items() if k is not None} == SAID
    assert got["plain words"][2] == 0.0 and got["  can it run"][2] == 0.5 and got["How do we deploy?"][2] == 1.0 and got["Rule: no tabs"][2] == 0.75
    assert got["use the naming convention here"][2] == 0.5
    kinds = {r["said"]: r["c"]["entry_type"] for r in df.collect()}
    assert kinds["use the naming convention here"] == "guideline" and kinds["npm scripts"] == "tool" and kinds["Rule: no tabs"] is None and kinds[None] is None
    assert {v[0] for v in SAID.values()} == {*commands.COMMANDS, "unknown"}


WORK = {
    "fix the login bug": (True, "bug_fix", 0.7), "fixing an error: resolve the problem": (True, "bug_fix", 0.9), "add support for new api": (True, "feature", 0.8), "refactor": (True, "refactor", 0.7),
    "look into why it fails to work": (False, None, 0.0), "dig into the cache": (True, "investigation", 0.7), "set up hooks": (True, "implementation", 0.7), "tuesday afternoon notes": (True, None, 0.5),
    "misc": (False, None, 0.0), "a question about it all": (False, None, 0.0), "quick fix of the bug": (False, None, 0.0),
}


def test_announced_work(spark):
    df = spark.createDataFrame([(t,) for t in [*WORK, None]], "said string").select("said", commands.announced_work(F.col("said")).alias("w"))
    got = {r["said"]: tuple(r["w"]) for r in df.collect()}
    assert {k: v for k, v in got.items() if k is not None} == WORK and got[None][0] is False


def test_search_terms_drop_stop_words_and_extend_short_ones():
    terms = text.fts_terms('where "should" the docker* auth build, error?', fulltext.STOP_WORDS)
    assert fulltext.pattern_terms(terms) == [("docker", False), ("auth", True), ("build", False), ("error", False)]
    assert len(fulltext.STOP_WORDS) == 117 and len(fulltext.COMPLETE_WORDS) == 46


def test_fnv1a(spark):
    def slow(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % (1 << 32)
        return h

    texts = ["", "a", "foobar", "ünï 漢字 🙂", "x" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ranking.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == [slow(t) for t in texts] and slow("foobar") == 0xBF9CF968


def test_sealed_cursors():
    secret, now = "s" * 32, 1_000_000
    values = {"p": 3, "name": "ü/+", "none": None}
    token = cursors.sealed(values, secret, now)
    assert cursors.opened(token, secret, now + cursors.HOUR_MS) == values and "name" not in token and not set(token) & set("+/=")
    with pytest.raises(cursors.ExpiredCursor):
        cursors.opened(token, secret, now + cursors.HOUR_MS + 1)
    assert cursors.opened(cursors.sealed(values, secret, now, None), secret, now * 10**6) == values
    changed = base64.urlsafe_b64encode(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).replace(b'"p":3', b'"p":4')).decode()
    for bad, key in ((changed, secret), (token, "t" * 32), ("", secret), ("!!", secret), (token[:-5], secret), (base64.urlsafe_b64encode(b"[1]").decode(), secret)):
        with pytest.raises(cursors.BadCursor):
            cursors.opened(bad, key, now)
    with pytest.raises(ValueError):
        cursors.sealed(values, "short", now)


def test_pages_by_cursor_are_the_whole_order(spark):
    rows = spark.createDataFrame([(k, k % 5) for k in range(37)], "id long, p int")
    keys, seen, cursor = [("p", True), ("id", False)], [], None
    while page := ranking.page_after(rows, keys, cursor, 8).collect():
        seen += [(r["id"], r["p"]) for r in page]
        cursor = page[-1].asDict()
    assert seen == sorted(((k, k % 5) for k in range(37)), key=lambda r: (-r[1], r[0]))
