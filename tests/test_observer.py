import random
from datetime import datetime, timedelta

import pytest

from sparkloom import registry
from sparkloom.sources.views import micros
from sparkloom.streaming import observer
from sparkloom.streaming.observer import Limits, Session, Step
from sparkloom.streaming.windows import as_pattern

DAY = 86_400_000_000
HOUR = DAY // 24


def steps(text):
    """v e c p for view, error, click, purchase; the k-th step has id k."""
    kinds = {"v": "view", "e": "error", "c": "click", "p": "purchase", "s": "signup"}
    return [Step(k, k, kinds[x[0]], x[1:] or None) for k, x in enumerate(text.split())]


@pytest.mark.parametrize(("text", "pattern", "span"), [
    ("v s e s v", "stale_code", (0, 4)), ("v e s", "stale_code", None), ("c v s c", "config_discovery", (1, 3)), ("p1 p2 p8", "dependency_chain", (0, 2)),
    ("p1 p8 p1", "dependency_chain", None), ("ca cb ca s cb ca", "retry_variant", (0, 5)), ("c s p", "build_then_test", (0, 2)), ("c s s p", "build_then_test", None),
    ("p v v p p", "investigation_success", (2, 3)), ("s c v c c e", "iterative_fix", (1, 4)), ("c c e c c", "iterative_fix", None), ("c c s c c c", "iterative_fix", (3, 5)),
])
def test_detectors(text, pattern, span):
    found = {name: (i, j) for name, _, i, j in observer.detected(steps(text))}
    assert found.get(pattern) == span


def test_the_buffer_is_bounded_and_forgets():
    s = Session(Limits(most=5, expiry_us=10, quiet_us=1000))
    for k in range(50):
        s.take(Step(k, k, "view", None))
        assert len(s.buffer) <= 5
    assert s.n == 50 and [x.us for x in s.buffer] == [45, 46, 47, 48, 49]
    s.take(Step(58, 50, "view", None))
    assert [x.us for x in s.buffer] == [48, 49, 58]
    s.take(Step(47, 51, "view", None))  # late, and older than what the buffer has let go
    s.take(Step(57, 52, "click", None))  # late, takes its place
    assert [x.us for x in s.buffer] == [48, 49, 57, 58] and s.n == 53


def expected(rows, limits, delay_us):
    by, last = {}, max(r[2] for r in rows)
    for user, event_id, us, kind, target in rows:
        by.setdefault(user, []).append(Step(us, event_id, kind, target))
    return sorted((u, *r) for u, s in by.items() for r in observer.replay(sorted(s), limits, (last - delay_us) // 1000 * 1000))


def test_query_equals_the_plain_rule(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    rows = [tuple(r) for r in events.select("user_id", "event_id", micros("ts"), "event_type", "props").collect()]
    want = expected(rows, Limits(expiry_us=7 * DAY, quiet_us=DAY), 600_000_000)
    got = sorted(tuple(r) for r in registry.QUERIES["session_behaviours"](spark, data).collect())
    assert got == want and len({r[4] for r in got}) >= 6


def test_many_batches_open_sessions_and_nulls(spark, tmp_path):
    """Ten files, one a batch: sessions go on across batches, end by a timer, or stay open; a user with a third of all steps."""
    rnd = random.Random(6)
    start, rows = datetime(2024, 1, 1), []
    for k in range(600):
        at = start + timedelta(minutes=4 * k + rnd.random())
        rows.append((1 if k % 3 == 0 else rnd.randrange(2, 9), k, at, rnd.choice(["view", "click", "purchase", "error", "signup"]), f'{{"k": {rnd.randrange(5)}}}'))
    schema = "user_id long, event_id long, ts timestamp_ntz, event_type string, props string"
    for k in range(10):
        part = rows[60 * k : 60 * k + 60] + ([(None, 1, start, "view", None), (3, 2, None, "view", None), (3, 3, start, None, None)] if k == 0 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "e" / f"part={k}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(10):
        next((tmp_path / "e" / f"part={k}").glob("part-*.parquet")).rename(flat / f"{k}.parquet")
    limits = Limits(most=8, expiry_us=HOUR, quiet_us=HOUR // 2)
    got = sorted(tuple(r) for r in observer.observed(spark, str(flat) + "/", limits, files_per_batch=1).collect())
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    want = expected([(u, e, us(t), kind, p) for u, e, t, kind, p in rows], limits, 600_000_000)
    assert got == want and len(got) > 25


def test_patterns_for_paths(spark, tmp_path):
    for name in ("plain", "with[brackets]", "a{b}*", "ends]"):
        spark.range(3).write.parquet(str(tmp_path / name))
        assert spark.read.parquet(as_pattern(f"{tmp_path / name}/")).count() == 3
