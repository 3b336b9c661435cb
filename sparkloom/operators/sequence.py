"""Ordered-event operators: detectors of step patterns, islands, windows over turns, boundaries, sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_pattern(steps: DataFrame, first: Column, then: Column, last: Column) -> DataFrame:
    """(user_id, i, j, k): in each session the smallest i < j < k whose steps match in turn, with any steps between.

    The greedy choice of i, then j, then k gives the smallest triple, so three grouped minima are enough.
    """
    a = steps.filter(first).groupBy("user_id").agg(F.min("n").alias("i"))
    b = steps.filter(then).join(a, "user_id").filter("n > i").groupBy("user_id", "i").agg(F.min("n").alias("j"))
    return steps.filter(last).join(b, "user_id").filter("n > j").groupBy("user_id", "i", "j").agg(F.min("n").alias("k"))


def follows_within(steps: DataFrame, first: Column, then: Column, reach: int) -> DataFrame:
    """(user_id, n, gap): steps that match ``first`` with the nearest match of ``then`` in the next ``reach`` steps."""
    order = Window.partitionBy("user_id").orderBy("n")
    gap = F.coalesce(*[F.when(F.lead(then.cast("int"), k).over(order) == 1, k) for k in range(1, reach + 1)])
    return steps.withColumn("gap", F.when(first, gap)).filter("gap is not null").select("user_id", "n", "gap")


def islands(steps: DataFrame, inside: Column, between: Column, least: int) -> DataFrame:
    """(user_id, first, last, hits): runs of at least ``least`` ``inside`` steps with only ``between`` steps among them."""
    order = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = steps.withColumn("island", F.sum(F.when(inside | between, 0).otherwise(1)).over(order)).filter(inside)
    runs = marked.groupBy("user_id", "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("hits"))
    return runs.filter(F.col("hits") >= least).drop("island")


def time_gaps(events: DataFrame, gap_us: int) -> DataFrame:
    """(user_id, event_id, gap_us): events that come more than ``gap_us`` after the one before in their session."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    return events.withColumn("gap_us", F.col("us") - F.lag("us").over(order)).filter(F.col("gap_us") > gap_us).select("user_id", "event_id", "gap_us")


def sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """(user_id, first_us, last_us, n): runs of events with gaps of at most ``gap_us``."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    start = F.coalesce((F.col("us") - F.lag("us").over(order) > gap_us).cast("int"), F.lit(1))
    numbered = events.withColumn("start", start).withColumn("s", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "s").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("s")


def turn_windows(turns: DataFrame, size: int = 10, overlap: int = 3, least_new: int = 2) -> DataFrame:
    """(conv_id, start, stop): windows of ``size`` turns that share ``overlap`` with the one before and bring ``least_new`` new ones."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    step = size - overlap
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(step).cast("long"))).alias("start")
    stop = F.least(F.col("start") + size - 1, F.col("last"))
    return last.select("conv_id", "last", starts).withColumn("stop", stop).filter(F.col("stop") - F.col("start") + 1 - F.when(F.col("start") > 0, overlap).otherwise(0) >= least_new).select("conv_id", "start", "stop")


def first_pair(steps: DataFrame, first: Column, then: Column) -> DataFrame:
    """(user_id, i, j): in each session the first step that matches ``first`` and the next that matches ``then``."""
    a = steps.filter(first).groupBy("user_id").agg(F.min("n").alias("i"))
    return steps.filter(then).join(a, "user_id").filter("n > i").groupBy("user_id", "i").agg(F.min("n").alias("j"))


def repeated_command(rows: DataFrame) -> DataFrame:
    """(user_id, i, j): the first command (user_id, k, base, command) that comes again with other arguments, one command between at least.

    Whether a later one exists is told from the last place of each command: no two commands of a session are paired.
    """
    last = rows.groupBy("user_id", "base", "command").agg(F.max("k").alias("m"))
    top = last.groupBy("user_id", "base").agg(F.max(F.struct("m", "command")).alias("t"))
    second = last.join(top, ["user_id", "base"]).filter("command <> t.command").groupBy("user_id", "base").agg(F.max("m").alias("m2"))
    reach = top.join(second, ["user_id", "base"], "left")
    far = F.when(F.col("command") == F.col("t.command"), F.col("m2")).otherwise(F.col("t.m"))
    first = rows.join(reach, ["user_id", "base"]).filter(far >= F.col("k") + 2).groupBy("user_id").agg(F.min(F.struct("k", "base", "command")).alias("f"))
    first = first.select("user_id", F.col("f.k").alias("i"), F.col("f.base").alias("base"), F.col("f.command").alias("own"))
    return rows.join(first, ["user_id", "base"]).filter("command <> own and k >= i + 2").groupBy("user_id", "i").agg(F.min("k").alias("j"))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        match = np.array([x == y for y in b], dtype=np.int64)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + match))
    return int(row[-1])


@F.pandas_udf(T.LongType())
def common_length_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def trajectory_similarity(events: DataFrame) -> DataFrame:
    """(user_id, day, similarity, confidence) of each user's day with the day after.

    0.35 common subsequence, 0.25 step sets, 0.15 tool sets (here the steps again), 0.15 outcomes by edit distance, 0.1 length;
    a day is short (one session's steps), so it fits into a row.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"])
    days = events.groupBy("user_id", "day").agg(ordered.alias("a"))
    after = days.select("user_id", F.date_sub("day", 1).alias("day"), F.col("a").alias("b"))
    both = days.join(after, ["user_id", "day"]).withColumn("common", common_length_udf("a", "b"))
    na, nb = F.size("a"), F.size("b")
    sets = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    outcome = lambda c: F.array_join(F.transform(c, lambda t: F.when(t == "error", "0").otherwise("1")), "")
    edits = 1 - F.levenshtein(outcome("a"), outcome("b")) / F.greatest(na, nb)
    value = 0.35 * (2 * F.col("common") / (na + nb)) + 0.4 * sets + 0.15 * edits + 0.1 * (F.least(na, nb) / F.greatest(na, nb))
    return both.select("user_id", "day", F.round(value, 6).alias("similarity"), F.least(F.lit(1.0), (na + nb) / 10.0).alias("confidence"))


def next_windows(turns: DataFrame, least: int = 500, most: int = 4000, size: int = 10, overlap: int = 3, fresh: int = 2) -> DataFrame:
    """(conv_id, start, stop, tokens, new_turns): the window after the first half of each conversation (conv_id, turn, role, text).

    It starts ``overlap`` turns before the unread ones and takes up to ``size`` turns while they have at most ``most`` tokens, one at least.
    No window without ``fresh`` unread turns or with fewer than ``least`` tokens. Only a window's own rows are sorted.
    """
    rows = turns.filter("turn is not null").withColumn("tokens", F.ceil(F.length(F.coalesce("text", F.lit(""))) * 0.25).cast("long"))
    ends = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")).withColumn("done", F.floor(F.col("n") / 2)).filter(F.col("n") - F.col("done") >= fresh)
    ends = ends.select("conv_id", "done", F.greatest(F.lit(0), F.col("done") - overlap).alias("start"))
    inside = rows.join(ends, "conv_id").filter((F.col("turn") >= F.col("start")) & (F.col("turn") < F.col("start") + size))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    taken = inside.select("*", running.alias("running"), F.row_number().over(order).alias("place")).filter((F.col("running") <= most) | (F.col("place") == 1))
    out = taken.groupBy("conv_id", "start").agg((F.max("turn") + 1).alias("stop"), F.sum("tokens").alias("tokens"), F.max("done").alias("done"))
    return out.filter(F.col("tokens") >= least).select("conv_id", "start", "stop", "tokens", F.greatest(F.lit(0), F.col("stop") - F.col("done")).alias("new_turns"))
