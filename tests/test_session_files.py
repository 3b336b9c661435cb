import json
import os
import time

import pytest

from sparkloom.shared import new_path
from sparkloom.sources import session_files


def put(base, path, value):
    full = os.path.join(base, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, indent=2))


@pytest.fixture
def tree(tmp_path):
    base = str(tmp_path / "storage")
    put(base, "session/p1/a.json", {"id": "s1", "slug": "slug-one", "directory": "/one", "time": {"created": 1000, "updated": 5000}})
    put(base, "session/p2/b.json", {"id": "s2", "title": "Two", "slug": "x", "directory": "/two", "time": {"created": 2000}})
    put(base, "session/global/g.json", {"id": "s3", "directory": "/one", "time": {"created": 1}})
    put(base, "session/p1/broken.json", '{"id": "s4", "time": {')
    put(base, "session/p1/notes.txt", "no transcript")
    put(base, "message/s1/m1.json", {"id": "m1", "sessionID": "s1", "role": "user", "time": {"created": 1100}, "agent": "build", "model": {"providerID": "p", "modelID": "mo"}})
    put(base, "message/s1/m2.json", {"id": "m2", "sessionID": "s1", "role": "assistant", "time": {"created": 1200}})
    put(base, "message/s1/m3.json", {"id": "m3", "sessionID": "s1", "role": "other", "time": {"created": 1050}})
    put(base, "message/s1/m4.json", {"id": "m4", "sessionID": "s1", "role": "user", "time": {"created": 1300}})
    put(base, "message/s1/m5.json", "{}")
    put(base, "part/m1/02.json", {"id": "p2", "messageID": "m1", "type": "text", "text": "second line"})
    put(base, "part/m1/01.json", {"id": "p9", "messageID": "m1", "type": "text", "text": "first\nline"})
    put(base, "part/m1/03.json", {"id": "p3", "messageID": "m1", "type": "tool", "tool": "grep", "state": {"status": "completed", "output": "x"}})
    put(base, "part/m1/04.json", {"id": "p4", "messageID": "m1", "type": "text", "text": ""})
    put(base, "part/m2/a.json", {"id": "t1", "messageID": "m2", "type": "tool", "tool": "bash", "state": {"status": "error", "input": {"command": "c" * 200, "n": 1}, "output": "o" * 6000}})
    put(base, "part/m2/b.json", {"id": "t2", "messageID": "m2", "type": "tool", "tool": "edit", "state": {"status": "completed"}})
    put(base, "part/m2/c.json", {"id": "t3", "messageID": "m2", "type": "tool", "tool": "read"})
    put(base, "part/m2/d.json", {"id": "t4", "messageID": "m2", "type": "step-start"})
    put(base, "part/m3/a.json", {"id": "u1", "messageID": "m3", "type": "text", "text": "early"})
    return base


def test_sessions(spark, tree):
    files = session_files.read_files(spark, tree)
    rows = session_files.sessions(files).selectExpr("session_id", "project_path", "title", "unix_millis(created)", "unix_millis(updated)").collect()
    assert sorted(map(tuple, rows)) == [("s1", "/one", "slug-one", 1000, 5000), ("s2", "/two", "Two", 2000, None)]
    assert [r["session_id"] for r in session_files.sessions(files, "/two").collect()] == ["s2"]


def test_messages(spark, tree):
    found = {r["message_id"]: r for r in session_files.messages(session_files.read_files(spark, tree)).collect()}
    assert set(found) == {"m1", "m2", "m3"}  # m4 has no parts, m5 no id
    one, two = found["m1"], found["m2"]
    assert (one["content"], one["tools"], one["calls"], one["role"], one["agent"], one["model"]) == ("first\nline\nsecond line", ["grep"], [], "user", "build", "mo")
    given = json.dumps({"command": "c" * 200, "n": 1}, separators=(",", ":"))
    assert two["content"].split("\n") == [f"[bash (error): {given[:100]}...]", "[edit]", "[Tool calls: read]"]
    assert [(c["name"], c["status"], c["input"]) for c in two["calls"]] == [("bash", "error", given), ("edit", "completed", None)]
    assert two["calls"][0]["output"] == "o" * 5000 + session_files.CUT and found["m3"]["role"] == "assistant"


def test_time_range_and_limit(spark, tree):
    files = session_files.read_files(spark, tree)
    ids = lambda **k: sorted(r["message_id"] for r in session_files.messages(files, **k).collect())
    assert ids(after_ms=1100) == ["m1", "m2"] and ids(before_ms=1100) == ["m1", "m3"] and ids(limit=1) == ["m3"] and ids(after_ms=1060, limit=1) == ["m1"]


def test_a_second_sync_reads_new_files_only(spark, tree):
    store = new_path(spark, "store")
    assert {r["message_id"] for r in session_files.sync(spark, tree, store).collect()} == {"m1", "m2", "m3"}
    assert session_files.sync(spark, tree, store).collect() == []
    time.sleep(1.1)
    put(tree, "part/m4/a.json", {"id": "v1", "messageID": "m4", "type": "text", "text": "late part"})
    put(tree, "part/m3/b.json", {"id": "u1", "messageID": "m3", "type": "text", "text": "early, edited"})
    put(tree, "message/s9/m9.json", {"id": "m9", "sessionID": "s9", "role": "user", "time": {"created": 9}})
    second = {r["message_id"]: r["content"] for r in session_files.sync(spark, tree, store).collect()}
    assert second == {"m3": "early, edited", "m4": "late part"}
    put(tree, "part/m9/a.json", {"id": "w1", "messageID": "m9", "type": "text", "text": "now"})
    assert [(r["message_id"], r["content"]) for r in session_files.sync(spark, tree, store).collect()] == [("m9", "now")]
    every = session_files.messages(session_files.stored(spark, store))
    assert {r["message_id"] for r in every.collect()} == {"m1", "m2", "m3", "m4", "m9"}
