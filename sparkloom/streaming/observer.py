"""Behaviour observer: what a session does is watched as it happens and judged when it ends.

A session's state is a buffer of its last ``most`` steps that are not older than ``expiry_us``, and four numbers. A step that comes after
``quiet_us`` of silence ends the session before it; a session that nothing follows is ended by a timer, once the watermark is past the silence. Then seven
detectors look at the buffer, and the state goes.

Steps of one micro-batch are taken in order of time. A step that is late by less than the watermark's delay takes its place in the buffer; one that is
older than the running session is left out of it. ``maxFilesPerTrigger`` and ``maxBytesPerTrigger`` bound what a session gets at once.

Defined cases: steps without user, time or kind are left out; repeated event ids are steps of their own; sessions that the watermark has not
passed are still open and give no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shared import new_path
from ..sources.views import micros
from .windows import as_pattern, drain

#: Fixed values of the observer: steps a buffer holds, their greatest age, the silence that ends a session.
MOST, EXPIRY_US, QUIET_US = 100, 3_600_000_000, 1_800_000_000
SESSION = "n long, first_us long, last_us long, kept_us long, us array<long>, event_id array<long>, kind array<string>, target array<string>"
OUT = "user_id long, first_us long, last_us long, steps long, pattern string, confidence double, first_id long, last_id long"


class Step(NamedTuple):
    us: int
    event_id: int
    kind: str
    target: str | None


Span = tuple[int, int] | None


def looks_back(steps: Sequence[Step]) -> Span:
    """A look, an error some time after it, and a look after that."""
    for i, a in enumerate(steps):
        if a.kind == "view":
            j = next((j for j in range(i + 1, len(steps)) if steps[j].kind == "error"), None)
            k = next((k for k in range(j + 1, len(steps)) if steps[k].kind == "view"), None) if j else None
            return (i, k) if k else None
    return None


def finds_cause(steps: Sequence[Step]) -> Span:
    """A look and an edit after it."""
    i = next((i for i, s in enumerate(steps) if s.kind == "view"), None)
    j = next((j for j in range(i + 1, len(steps)) if steps[j].kind == "click"), None) if i is not None else None
    return (i, j) if j else None


def needs_other(steps: Sequence[Step]) -> Span:
    """A command that is run again with other arguments, after at least one other command. A target's number modulo 7 is its command."""
    base = lambda t: int("".join(c for c in t if c.isdigit()) or 0) % 7
    runs = [(k, s.target, base(s.target)) for k, s in enumerate(steps) if s.kind == "purchase" and s.target]
    for x, (i, a, own) in enumerate(runs):
        for j, b, other in runs[x + 2 :]:
            if own == other and a != b:
                return i, j
    return None


def edits_again(steps: Sequence[Step]) -> Span:
    """The first target that is edited twice or more, from its first edit to its last."""
    places: dict[str, list[int]] = {}
    for k, s in enumerate(steps):
        if s.kind == "click" and s.target:
            places.setdefault(s.target, []).append(k)
    return next(((p[0], p[-1]) for p in places.values() if len(p) > 1), None)


def builds_then_tests(steps: Sequence[Step]) -> Span:
    """An edit, and a command among the next two steps."""
    for i, s in enumerate(steps):
        if s.kind == "click":
            for j in range(i + 1, min(i + 3, len(steps))):
                if steps[j].kind == "purchase":
                    return i, j
    return None


def looks_then_acts(steps: Sequence[Step]) -> Span:
    """The first command that any look came before, and the last look before it."""
    seen = None
    for k, s in enumerate(steps):
        if s.kind == "view":
            seen = k
        elif s.kind == "purchase" and seen is not None:
            return seen, k
    return None


def refines(steps: Sequence[Step]) -> Span:
    """The first run of three edits or more with only looks among them."""
    first = last = None
    n = 0
    for k, s in enumerate(steps):
        if s.kind == "click":
            first, last, n = k if n == 0 else first, k, n + 1
        elif s.kind != "view":
            if n >= 3:
                break
            n = 0
    return (first, last) if n >= 3 else None


# How sure each detector is, and how many steps it wants to see.
DETECTORS: tuple[tuple[str, float, int, Callable[[Sequence[Step]], Span]], ...] = (
    ("stale_code", 0.85, 3, looks_back), ("config_discovery", 0.8, 3, finds_cause), ("dependency_chain", 0.75, 3, needs_other), ("retry_variant", 0.7, 3, edits_again),
    ("build_then_test", 0.85, 2, builds_then_tests), ("investigation_success", 0.75, 3, looks_then_acts), ("iterative_fix", 0.7, 4, refines),
)


def detected(steps: Sequence[Step]) -> list[tuple[str, float, int, int]]:
    """(pattern, confidence, first event, last event) of each detector that finds something in a buffer."""
    out = []
    for name, confidence, least, find in DETECTORS:
        span = find(steps) if len(steps) >= least else None
        if span:
            out.append((name, confidence, steps[span[0]].event_id, steps[span[1]].event_id))
    return out


@dataclass(frozen=True)
class Limits:
    most: int = MOST
    expiry_us: int = EXPIRY_US
    quiet_us: int = QUIET_US


class Session:
    """A session as it goes: the buffer and how many steps there were from when to when. ``kept_us``: no step up to then is in the buffer any more."""

    def __init__(self, limits: Limits, buffer: Sequence[Step] = (), n: int = 0, first_us: int | None = None, last_us: int | None = None, kept_us: int | None = None):
        self.limits, self.buffer, self.n, self.first_us, self.last_us, self.kept_us = limits, deque(buffer), n, first_us, last_us, kept_us

    def ended_by(self, us: int) -> bool:
        return self.last_us is not None and us - self.last_us >= self.limits.quiet_us

    def take(self, step: Step) -> None:
        if self.first_us is not None and step.us < self.first_us:
            return  # older than the session
        self.n += 1
        self.first_us = step.us if self.first_us is None else self.first_us
        self.last_us = step.us if self.last_us is None else max(self.last_us, step.us)
        if self.kept_us is not None and step.us <= self.kept_us:
            return
        late = bool(self.buffer) and step[:2] < self.buffer[-1][:2]
        self.buffer.append(step)
        if late:
            self.buffer = deque(sorted(self.buffer, key=lambda s: s[:2]))
        while len(self.buffer) > self.limits.most or self.last_us - self.buffer[0].us > self.limits.expiry_us:
            self.kept_us = self.buffer.popleft().us

    def rows(self) -> list[tuple]:
        return [(self.first_us, self.last_us, self.n, *found) for found in detected(list(self.buffer))]


def replay(steps: Sequence[Step], limits: Limits, watermark_us: int) -> list[tuple]:
    """What the observer gives for one user's steps in order of time: the rule without a stream."""
    out, session = [], Session(limits)
    for s in steps:
        if session.ended_by(s.us):
            out += session.rows()
            session = Session(limits)
        session.take(s)
    return out + (session.rows() if session.last_us is not None and session.last_us + limits.quiet_us <= watermark_us else [])


class Observer(StatefulProcessor):
    def __init__(self, limits: Limits = Limits()):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)

    def _frame(self, user_id: int, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(user_id, *r) for r in rows], columns=["user_id", "first_us", "last_us", "steps", "pattern", "confidence", "first_id", "last_id"])

    def _load(self) -> Session:
        if not self.session.exists():
            return Session(self.limits)
        n, first_us, last_us, kept_us, *columns = self.session.get()
        return Session(self.limits, [Step(*s) for s in zip(*columns)], n, first_us, last_us, kept_us)

    def _timer(self, session: Session) -> int:
        return (session.last_us + self.limits.quiet_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A call of the state is a message to the store, dearer than a step; a user costs three, or five with a session that goes on."""
        session, out = self._load(), []
        timer = None if session.last_us is None else self._timer(session)
        steps = sorted((s for r in rows for s in zip(*(r[c].tolist() for c in Step._fields))), key=lambda s: s[:2])
        for us, event_id, kind, target in steps:
            if session.ended_by(us):
                out += session.rows()
                session = Session(self.limits)
            session.take(Step(us, event_id, kind, target))
        if timer != self._timer(session):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._timer(session))
        self.session.update((session.n, session.first_us, session.last_us, session.kept_us, *(list(c) for c in zip(*session.buffer))))
        if out:
            yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._load().rows()
        self.session.clear()
        if out:
            yield self._frame(key[0], out)

    def close(self) -> None:
        pass


#: Lists of state and timers need this store.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def observer_stream(events: DataFrame, limits: Limits = Limits(), delay: str = "10 minutes") -> DataFrame:
    """A row for each pattern of each ended session; ``events``: user_id, event_id, ts, kind, target."""
    able = events.filter("user_id is not null and ts is not null and kind is not null").withColumn("us", micros("ts"))
    return able.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(Observer(limits), OUT, "append", "eventTime")


def observed(spark: SparkSession, path: str, limits: Limits = Limits(), delay: str = "10 minutes", files_per_batch: int = 100) -> DataFrame:
    """The patterns of the event files at ``path``, by a stream that is drained. The state's settings are those of a session of its own."""
    own = spark.newSession()
    for k, v in ROCKS.items():
        own.conf.set(k, v)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    raw = own.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(path))
    events = raw.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("props").alias("target"))
    home = new_path(spark, "observer")
    drain(observer_stream(events, limits, delay), "observer", "append", home)
    return spark.read.schema(f"{OUT}, batch_no long").parquet(f"{home}/out/*").drop("batch_no")
