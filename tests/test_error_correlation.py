"""Correlations of agents' errors: what pairs share is counted where blocks meet, and no join spells out each shared task."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import feedback


def _votes(spark):
    rows = [(k % 7, k * k % 11, "error" if k * 5 % 13 < 4 else None if k % 17 == 3 else "view") for k in range(220)]
    return spark.createDataFrame(rows + [(None, 3, "error"), (2, None, "error"), (99, 50, None), (99, 51, None)], "task_id long, agent_id long, vote string")


def _plain(votes, wrong):
    seen = votes.groupBy("agent_id", "task_id").agg(F.max(wrong.cast("int")).alias("w"))
    t = seen.groupBy("agent_id").agg(F.count(F.lit(1)).alias("t"), F.sum("w").alias("e"))
    x, y = seen.toDF("a", "task_id", "wa"), seen.toDF("b", "task_id", "wb")
    p = x.join(y, "task_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"), F.sum(F.expr("wa * wb")).alias("both")).join(t.toDF("a", "ta", "ea"), "a").join(t.toDF("b", "tb", "eb"), "b")
    p = p.withColumn("n", F.expr("ta + tb - s")).withColumn("d", F.expr("sqrt(cast(ea * (n - ea) * eb * (n - eb) as double))"))
    return p.select("a", "b", "both", "n", F.expr("round(case when d = 0 then 0.0 else least(1.0D, greatest(-1.0D, (n * both - ea * eb) / d)) end, 6)"))


@pytest.mark.parametrize("agents, tasks", [(1024, 4096), (3, 2), (4, 4096)])
def test_any_blocks_and_chunks_give_the_plain_join(spark, agents, tasks):
    votes = _votes(spark)
    got = feedback.agent_error_correlation(votes, F.col("vote") == "error", agents, tasks)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, _plain(votes, F.col("vote") == "error").collect()), key=str)
    assert got.columns == ["a", "b", "both", "union", "correlation"]


def test_no_row_for_each_shared_task(spark):
    rows = spark.range(60 * 50).selectExpr("id % 50 as task_id", "id div 50 as agent_id", "'error' as vote")
    found = feedback.agent_error_correlation(rows, F.col("vote") == "error")
    assert found.count() == 60 * 59 // 2
    assert not re.search(r"\(task_id#\d+L? = task_id#", found._jdf.queryExecution().optimizedPlan().toString())


def test_agents_move_a_bounded_number_of_times(spark, monkeypatch):
    """Blocks grow with the agents: 2,000 of them in blocks of 4 were 500 rows each before."""
    monkeypatch.setattr(feedback, "PAIRS", 700)
    rows = spark.range(2000 * 3).selectExpr("id % 3 as task_id", "id div 3 as agent_id", "case when id % 7 = 0 then 'error' else 'view' end as vote")
    sent = []
    plain = F.sequence
    monkeypatch.setattr(feedback.F, "sequence", lambda a, b: sent.append(b._jc.toString()) or plain(a, b))
    found = feedback.agent_error_correlation(rows, F.col("vote") == "error", agents=4, tasks=2000)
    assert sent and int(sent[0]) <= 25
    assert found.count() == 2000 * 1999 // 2
