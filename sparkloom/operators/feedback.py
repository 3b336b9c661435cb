"""Feedback attribution, voting, correlation, preference pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Agents of a block and tasks of a chunk; how often an agent moves, agents of the largest block, and pairs that leave a task at a time.
AGENTS, TASKS = 1024, 4096
MEETINGS, MOST_AGENTS, PAIRS = 24, 16_384, 1_000_000
REWARD = {"success": 1.0, "partial": 0.5, "failure": -1.0}


def reward(outcome: Column) -> Column:
    return F.coalesce(*[F.when(outcome == k, v) for k, v in REWARD.items()])


def attribute(links: DataFrame, method: str) -> DataFrame:
    """(outcome_id, retrieval_id, credit): an outcome's reward shared among its retrievals.

    linear: equally; last: all to the latest; decay: by a half-life of one hour; rank: by 1 / rank from the latest.
    """
    newest = Window.partitionBy("outcome_id").orderBy(F.desc("retrieved_us"), F.desc("retrieval_id"))
    group = Window.partitionBy("outcome_id")
    age_h = (F.col("outcome_us") - F.col("retrieved_us")) / 3.6e9
    weight = {
        "linear": F.lit(1.0),
        "last": F.when(F.row_number().over(newest) == 1, 1.0).otherwise(0.0),
        "decay": F.pow(F.lit(2.0), -age_h),
        "rank": 1.0 / F.row_number().over(newest),
    }[method]
    rows = links.withColumn("_w", weight)
    return rows.select("outcome_id", "retrieval_id", F.round(F.col("_w") / F.sum("_w").over(group) * reward(F.col("outcome")), 6).alias("credit"))


def net_feedback(links: DataFrame) -> DataFrame:
    """(entry_id, positive, negative, net): successes count one, partial ones a half, each sum rounded half up."""
    up = F.sum(F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "partial", 0.5).otherwise(0.0))
    down = F.sum(F.when(F.col("outcome") == "failure", 1.0).otherwise(0.0))
    by = links.groupBy("entry_id").agg(F.floor(up + 0.5).cast("long").alias("positive"), F.floor(down + 0.5).cast("long").alias("negative"))
    return by.withColumn("net", F.col("positive") - F.col("negative"))


def latest_votes(votes: DataFrame) -> DataFrame:
    """The last vote of each agent in each task, by one combined maximum."""
    best = votes.groupBy("task_id", "agent_id").agg(F.max(F.struct("event_id", "vote", "confidence")).alias("v"))
    return best.select("task_id", "agent_id", "v.vote", "v.confidence")


def consensus(votes: DataFrame, lead: int = 1) -> DataFrame:
    """(task_id, vote, votes, second, agreed, confidence): the leading option, if it leads by ``lead`` (a sole option always does)."""
    counts = votes.groupBy("task_id", "vote").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    ranked = counts.groupBy("task_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "vote")), asc=True).alias("o"), F.sum("n").alias("all"), F.sum("c").alias("conf")
    )  # as many elements as there are options
    first, second = F.col("o")[0], F.get(F.col("o"), 1)
    n, m = -first["m"], F.coalesce(-second["m"], F.lit(0))
    return ranked.select(
        "task_id", first["vote"].alias("vote"), n.alias("votes"), m.alias("second"), ((F.size("o") == 1) | (n - m >= lead)).alias("agreed"), F.round(F.col("conf") / F.col("all"), 6).alias("confidence")
    )


def agent_error_correlation(votes: DataFrame, wrong: Column, agents: int = AGENTS, tasks: int = TASKS) -> DataFrame:
    """(a, b, both, union, correlation) of agents' errors over the tasks that either voted on; phi coefficient, clamped to -1..1.

    All pairs of agents that share a task. Agents are dealt into blocks of some ``agents`` and their tasks into chunks of some ``tasks``; a task multiplies
    one pair of blocks in one chunk, so what two agents share is counted there and only their pair leaves it. Blocks grow with the agents, so that an agent moves no
    more than some ``MEETINGS`` times, up to ``MOST_AGENTS`` and to as many cells as ``agents`` have in ``tasks``; some pairs leave a task at a time.
    """
    seen = cut(votes.select("task_id", "agent_id", wrong.alias("wrong")).groupBy("agent_id", "task_id").agg(F.max(F.col("wrong").cast("int")).alias("wrong")), "votes")
    totals = seen.groupBy("agent_id").agg(F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("wrong"), F.lit(-1)).alias("errors"))
    n, m = seen.agg(F.countDistinct("agent_id"), F.countDistinct("task_id")).first()
    agents = max(agents, min(MOST_AGENTS, n // MEETINGS, agents * tasks // max(1, min(m, tasks))))
    blocks, chunks = max(1, math.ceil(n / agents)), max(1, math.ceil(m / tasks))
    cell = F.struct("task_id", F.coalesce("wrong", F.lit(-1)).cast("byte").alias("wrong"))
    rows = seen.filter("agent_id is not null and task_id is not null").groupBy("agent_id", F.pmod(F.xxhash64("task_id"), F.lit(chunks)).alias("chunk")).agg(F.sort_array(F.collect_list(cell)).alias("x"))
    rows = rows.select("agent_id", "chunk", F.transform("x", lambda c: c["task_id"]).alias("at"), F.transform("x", lambda c: c["wrong"]).alias("wrong")).join(totals, "agent_id")
    own = rows.withColumn("own", F.pmod(F.xxhash64("agent_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    kind = votes.schema["agent_id"].dataType.simpleString()
    counted = dealt.groupBy("i", "j", "chunk").applyInPandas(_shared_tasks, f"a {kind}, b {kind}, shared long, both long, ta long, ea long, tb long, eb long")
    if chunks > 1:
        counted = counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum("both").alias("both"), *[F.max(c).alias(c) for c in ("ta", "ea", "tb", "eb")])
    pairs = counted.withColumn("ea", F.nullif("ea", F.lit(-1))).withColumn("eb", F.nullif("eb", F.lit(-1)))
    n = F.col("ta") + F.col("tb") - F.col("shared")
    top = n * F.col("both") - F.col("ea") * F.col("eb")
    bottom = F.sqrt((F.col("ea") * (n - F.col("ea")) * F.col("eb") * (n - F.col("eb"))).cast("double"))
    phi = F.when(bottom == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), top / bottom)))
    return pairs.select("a", "b", "both", n.alias("union"), F.round(phi, 6).alias("correlation"))


def _shared_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each pair of agents of two blocks once, with how many tasks of a chunk they share and how often both were wrong (null where that isn't known of any)."""
    group = pd.concat(batches, ignore_index=True)
    i, j = group["i"].iloc[0], group["j"].iloc[0]
    names, place = np.unique(np.concatenate(group["at"].to_numpy()), return_inverse=True)
    row = np.repeat(np.arange(len(group)), group["at"].map(len).to_numpy())
    errs = np.concatenate(group["wrong"].to_numpy())
    cells = np.zeros((3, len(group), len(names)), dtype=np.float32)
    cells[0, row, place], cells[1, row, place], cells[2, row, place] = 1, errs == 1, errs >= 0
    home, other = np.flatnonzero(group["own"] == i), np.flatnonzero(group["own"] == j)
    ids, tasks, errors = (group[c].to_numpy() for c in ("agent_id", "tasks", "errors"))
    far = [c[other].T for c in cells]
    some = max(1, PAIRS // max(1, len(other)))
    for at in range(0, len(home), some):
        part = home[at : at + some]
        shared, both, known = (c[part] @ f for c, f in zip(cells, far))
        x, y = np.nonzero(shared)
        shared, both, known = shared[x, y], both[x, y], known[x, y]
        x, y = part[x], other[y]
        if i == j:
            once = ids[x] < ids[y]
            shared, both, known, x, y = shared[once], both[once], known[once], x[once], y[once]
        else:
            turned = ids[x] > ids[y]
            x, y = np.where(turned, y, x), np.where(turned, x, y)
        both = both.astype(np.int64) if known.all() else pd.arrays.IntegerArray(both.astype(np.int64), known == 0)
        yield pd.DataFrame({"a": ids[x], "b": ids[y], "shared": shared.astype(np.int64), "both": both, "ta": tasks[x], "ea": errors[x], "tb": tasks[y], "eb": errors[y]})


def preference_pairs(rows: DataFrame, state: str, gap: float = 0.1) -> DataFrame:
    """(state, chosen, rejected, margin): the best and the worst action of each state if they differ by more than ``gap``."""
    best = F.max(F.struct("value", (-F.col("id")).alias("i"))).alias("best")
    worst = F.min(F.struct("value", "id")).alias("worst")
    by = rows.groupBy(state).agg(best, worst)
    margin = F.col("best.value") - F.col("worst.value")
    return by.filter(margin > gap).select(state, (-F.col("best.i")).alias("chosen"), F.col("worst.id").alias("rejected"), F.round(margin, 6).alias("margin"))


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    """(id, score): reciprocal-rank fusion of ranked lists (id, rank)."""
    return lists.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
