"""Episode boundaries as a stateful stream: each session's last two windows of events are compared as events come in.

A session keeps its last ``2 * WINDOW`` events and the time of its last boundary as state, nothing else. Events of
one micro-batch are taken in order of time; ``maxFilesPerTrigger`` bounds what a session gets at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.views import micros
from .windows import as_pattern, drain

WINDOW = 5
GAP_US = 600_000_000
QUIET_US = 30_000_000
LEAST_SIMILAR = 0.65
OUT = "user_id long, event_id long, reason string, confidence double"
STATE = "us array<long>, target array<string>, last_us long"


def window_similarity(before: list[str | None], after: list[str | None]) -> float:
    """Cosine of the counts of what two windows are about."""
    a, b = Counter(t for t in before if t), Counter(t for t in after if t)
    size = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return sum(n * b[t] for t, n in a.items()) / size if size else 1.0


def step(
    events: list[tuple[int, int, str | None]], us: list[int], target: list[str | None], last_us: int | None, similarity: Callable[[list, list], float] | None = None
) -> tuple[list[tuple[int, str, float]], list[int], list[str | None], int | None]:
    """Take events (event_id, us, target) in order; returns boundaries (first event_id after it, reason, confidence) and the new state.

    A boundary lies between two windows if the time between them exceeds the gap, if both have targets and share none, or if
    ``similarity`` is given and finds them too unlike. After one, the second window is all that is remembered, and no other follows within the quiet time.
    """
    found = []
    ids: list[int | None] = [None] * len(us)
    for event_id, at, what in events:
        us, target, ids = [*us, at][-2 * WINDOW :], [*target, what][-2 * WINDOW :], [*ids, event_id][-2 * WINDOW :]
        if len(us) < 2 * WINDOW or (last_us is not None and at - last_us < QUIET_US):
            continue
        before, after = {t for t in target[:WINDOW] if t}, {t for t in target[WINDOW:] if t}
        if us[WINDOW] - us[WINDOW - 1] > GAP_US:
            reason, confidence = "time_gap", 0.6
        elif before and after and not before & after:
            reason, confidence = "context_shift", 0.7
        elif similarity and (like := similarity(target[:WINDOW], target[WINDOW:])) < LEAST_SIMILAR:
            reason, confidence = "similarity_drop", 1 - like
        else:
            continue
        found.append((event_id, reason, confidence))
        last_us, us, target, ids = at, us[WINDOW:], target[WINDOW:], ids[WINDOW:]
    return found, us, target, last_us


def _session(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, similarity: Callable[[list, list], float] | None = None) -> Iterator[pd.DataFrame]:
    us, target, last_us = ([], [], None) if not state.exists else state.get
    rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
    events = list(zip(rows["event_id"].tolist(), rows["us"].tolist(), rows["target"].tolist(), strict=True))
    found, us, target, last_us = step(events, list(us), list(target), last_us, similarity)
    state.update((us, target, last_us))
    yield pd.DataFrame([(key[0], *f) for f in found], columns=["user_id", "event_id", "reason", "confidence"])


def _session_similar(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    yield from _session(key, frames, state, window_similarity)


def boundary_stream(events: DataFrame, by_similarity: bool = False) -> DataFrame:
    """user_id, event_id (the event at which the boundary showed), reason, confidence; ``events``: user_id, event_id, us, target."""
    return events.groupBy("user_id").applyInPandasWithState(_session_similar if by_similarity else _session, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def episode_boundaries(spark: SparkSession, path: str, files_per_batch: int = 100, by_similarity: bool = False, about: str = "props") -> DataFrame:
    """All boundaries of the event files at ``path``, by a stream that is drained; an event's target is its column ``about``."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(path))
    events = raw.select("user_id", "event_id", micros("ts").alias("us"), F.col(about).alias("target"))
    return drain(boundary_stream(events, by_similarity), "boundaries", "append").drop("batch_no")
