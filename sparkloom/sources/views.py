"""Logical views of the memory model over the given tables.

Every derivation is arithmetic on keys, so that SQL can restate it; ``SQL`` holds the same views as
common table expressions. Times are whole hours since ``EPOCH``; reference time is ``AS_OF_HOURS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("tool", "guideline", "knowledge", "experience")
SCOPES = ("global", "org", "project", "session")
#: 2024-01-01 to 2024-02-01 in hours.
AS_OF_HOURS = 744


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's time zone."""
    parts = f"unix_date(cast({ts} as date)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60"
    return F.expr(f"({parts}) * 1000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry heads with their current content."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as entry_id",
        f"{_pick(TYPES, 'doc_id % 4')} as entry_type",
        "substring(text, 1, 40) as title",
        "text as content",
        "source as category",
        "lang",
        "doc_id * 37 % 720 as born_h",
        "doc_id * 31 % 101 as priority",
        "doc_id * 7 % 23 as access_count",
        "case when doc_id % 5 <> 0 then doc_id * 13 % 240 end as access_lag_h",
        "doc_id % 17 <> 0 as is_active",
        f"{_pick(SCOPES, '(doc_id div 4) % 4')} as scope_type",
        "case (doc_id div 4) % 4 when 1 then (doc_id div 16) % 5 when 2 then (doc_id div 16) % 25 when 3 then (doc_id div 16) % 10 end as scope_id",
    )


def entry_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, tag): language and source of each entry."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_id"), F.explode(F.array_compact(F.array("lang", "source"))).alias("tag"))


def scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sessions: session_id, project_id), (projects: project_id, org_id)."""
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("long").alias("project_id"))
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_regionkey").cast("long").alias("org_id"))
    return sessions, projects


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, relation_type): two outgoing edges for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.max("doc_id")).first()[0] or 0
    kinds = ("depends_on", "related_to", "applies_to", "conflicts_with", "parent_task", "subtask_of", "promoted_to")
    edge = F.explode(F.array(F.struct(F.lit(2).alias("m"), F.lit(1).alias("c")), F.struct(F.lit(3).alias("m"), F.lit(2).alias("c")))).alias("e")
    return docs.select("doc_id", edge).select(
        F.col("doc_id").alias("source_id"),
        ((F.col("doc_id") * F.col("e.m") + F.col("e.c")) % F.lit(n + 1)).alias("target_id"),
        F.expr(_pick(kinds, "(doc_id + e.c) % 7")).alias("relation_type"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, version_num, version_h, note): one to three versions of each entry, a few seconds or some hours apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("version_num")).select(
        F.col("doc_id").alias("entry_id"), F.col("version_num").cast("long").alias("version_num"),
        ((F.col("doc_id") * 37 % 720) * 3600 + (F.col("version_num") - 1) * (F.col("doc_id") % 9)).cast("long").alias("version_s"),
        F.concat(F.lit("v"), F.col("version_num").cast("string")).alias("note"),
    )


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, from_h, until_h) of knowledge entries; null is unbounded."""
    return table(spark, sf_dir, "documents").filter("doc_id % 4 = 2").selectExpr(
        "doc_id as entry_id", "case when doc_id % 7 <> 0 then doc_id * 37 % 720 end as from_h", "case when doc_id % 3 <> 0 then doc_id * 37 % 720 + (doc_id % 11) * 24 end as until_h"
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit log."""
    action = "case event_type when 'view' then 'query' when 'click' then 'create' when 'purchase' then 'update' when 'error' then 'delete' else 'login' end"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id as agent_id", f"{action} as action", "event_id % 97 as entry_id", f"{_pick(TYPES, 'event_id % 97 % 4')} as entry_type",
        f"{_pick(SCOPES, 'user_id % 4')} as scope_type",
        "value as execution_time", "event_type <> 'error' as success", "props as query_params",
        "case when event_type <> 'signup' then event_type end as subtask_type",
    )


def feedback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retrievals, outcomes, links): views and clicks; purchases, signups and errors; same user within a day."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("us"))
    retrievals = events.filter("event_type in ('view', 'click')").selectExpr(
        "event_id as retrieval_id", "user_id", "us as retrieved_us", "event_id % 97 as entry_id", f"{_pick(TYPES, 'event_id % 97 % 4')} as entry_type"
    )
    outcomes = events.filter("event_type in ('purchase', 'signup', 'error')").selectExpr(
        "event_id as outcome_id", "user_id", "us as outcome_us", "case event_type when 'purchase' then 'success' when 'signup' then 'partial' else 'failure' end as outcome"
    )
    # a range join by day buckets: an outcome looks in its own day and the one before
    day = 86_400_000_000
    bucketed = outcomes.withColumn("day", F.explode(F.array(F.expr(f"outcome_us div {day}"), F.expr(f"outcome_us div {day} - 1"))))
    near = (F.col("retrieved_us") <= F.col("outcome_us")) & (F.col("outcome_us") - F.col("retrieved_us") <= day)
    links = retrievals.withColumn("day", F.expr(f"retrieved_us div {day}")).join(bucketed, ["user_id", "day"]).filter(near).drop("day")
    return retrievals, outcomes, links


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as v", "label", f"{_pick(TYPES, 'label % 4')} as entry_type")


def text_vectors(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """(vec_id, v, lang): signed hash counts of the pairs of neighbouring words of each text of two words or more; texts that share most pairs are near."""
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), "")
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", "lang", F.explode(F.array(words)).alias("w")).filter(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.xxhash64(a, b))

    @F.pandas_udf("array<int>")
    def counts(hashes: pd.Series) -> pd.Series:
        """A text's pairs are counted where it is read: what is shuffled is a vector, not its pairs."""
        h, row = np.concatenate([np.zeros(0, dtype=np.int64), *hashes]), np.repeat(np.arange(len(hashes)), hashes.map(len))
        m = np.bincount(row * size + (h >> 1) % size, np.where(h % 2 == 0, 1.0, -1.0), len(hashes) * size)
        return pd.Series(list(m.astype(np.int32).reshape(-1, size)))

    # rows of one id and language are one text
    by = docs.select("doc_id", "lang", counts(pairs).alias("x")).groupBy("doc_id", "lang").agg(F.collect_list("x").alias("xs"))
    v = F.aggregate(F.slice("xs", 2, F.size("xs")), F.col("xs")[0].cast("array<double>"), lambda acc, x: F.zip_with(acc, x, lambda s, n: s + n))
    return by.select(F.col("doc_id").alias("vec_id"), v.alias("v"), "lang")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 50 as task_id", "user_id as agent_id", "event_type as vote", "value / 500 as confidence")


SQL = {
    "entries": """entries as (select doc_id as entry_id, ['tool','guideline','knowledge','experience'][(doc_id % 4 + 1)::int] as entry_type,
 substr(text, 1, 40) as title, text as content, source as category, lang, doc_id * 37 % 720 as born_h, doc_id * 31 % 101 as priority, doc_id * 7 % 23 as access_count,
 case when doc_id % 5 <> 0 then doc_id * 13 % 240 end as access_lag_h, doc_id % 17 <> 0 as is_active,
 ['global','org','project','session'][((doc_id // 4) % 4 + 1)::int] as scope_type,
 case (doc_id // 4) % 4 when 1 then (doc_id // 16) % 5 when 2 then (doc_id // 16) % 25 when 3 then (doc_id // 16) % 10 end as scope_id from documents)""",
    "entry_tags": "entry_tags as (select doc_id as entry_id, lang as tag from documents where lang is not null union all select doc_id, source from documents where source is not null)",
    "relations": """relations as (select doc_id as source_id, (doc_id * m + c) % (select max(doc_id) + 1 from documents) as target_id,
 ['depends_on','related_to','applies_to','conflicts_with','parent_task','subtask_of','promoted_to'][((doc_id + c) % 7 + 1)::int] as relation_type
 from documents, (values (2, 1), (3, 2)) k(m, c))""",
    "versions": """versions as (select doc_id as entry_id, version_num, (doc_id * 37 % 720) * 3600 + (version_num - 1) * (doc_id % 9) as version_s, 'v' || version_num as note
 from (select doc_id, unnest(range(1, doc_id % 3 + 2)) as version_num from documents))""",
    "validity": """validity as (select doc_id as entry_id, case when doc_id % 7 <> 0 then doc_id * 37 % 720 end as from_h,
 case when doc_id % 3 <> 0 then doc_id * 37 % 720 + (doc_id % 11) * 24 end as until_h from documents where doc_id % 4 = 2)""",
    "audit_log": """audit_log as (select event_id, ts, user_id as agent_id, case event_type when 'view' then 'query' when 'click' then 'create' when 'purchase' then 'update' when 'error' then 'delete' else 'login' end as action,
 event_id % 97 as entry_id, ['tool','guideline','knowledge','experience'][(event_id % 97 % 4 + 1)::int] as entry_type, ['global','org','project','session'][(user_id % 4 + 1)::int] as scope_type,
 value as execution_time, event_type <> 'error' as success, props as query_params, case when event_type <> 'signup' then event_type end as subtask_type from events)""",
    "feedback": """retrievals as (select event_id as retrieval_id, user_id, epoch_us(ts) as retrieved_us, event_id % 97 as entry_id, ['tool','guideline','knowledge','experience'][(event_id % 97 % 4 + 1)::int] as entry_type from events where event_type in ('view', 'click')),
outcomes as (select event_id as outcome_id, user_id, epoch_us(ts) as outcome_us, case event_type when 'purchase' then 'success' when 'signup' then 'partial' else 'failure' end as outcome from events where event_type in ('purchase', 'signup', 'error')),
links as (select * from retrievals join outcomes using (user_id) where retrieved_us <= outcome_us and outcome_us - retrieved_us <= 86400000000)""",
    "vectors": "vectors as (select vec_id, embedding::double[] as v, label, ['tool','guideline','knowledge','experience'][(label % 4 + 1)::int] as entry_type from embeddings)",
    "votes": "votes as (select event_id, event_id % 50 as task_id, user_id as agent_id, event_type as vote, value / 500 as confidence from events)",
}


def sql(body: str, *views: str) -> str:
    """A query over the named views."""
    return "with recursive " + ",\n".join(SQL[v] for v in views) + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().lstrip("+")


#: What people say in the message view, so that patterns have something to match.
SENTENCES = (
    "We decided to use the cache instead of the queue because tests show it is faster than before.",
    "Always use `make lint` before you commit.",
    "npm run build failed with an error again, the issue is still broken.",
    "It works now, thanks! Looks good.",
    "No idea what is wrong, giving up on this, will revisit.",
    "The report is mostly done, except for one more issue.",
    "Rule: never use tabs, we always use spaces over tabs.",
    "How to set up the environment variables?",
    "What is the difference between red and blue or green? And also when is it better?",
    "docker compose up",
    "Fact: the service is located in the north, as we found that it helps.",
    "We realized the bug and learned to fix it; avoid loops and prefer maps because they are more reliable.",
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, us, text): an event as a message of its user."""
    events = table(spark, sf_dir, "events")
    spoken = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (F.col("event_id") % len(SENTENCES) + 1).cast("int"))
    return events.select("event_id", "user_id", micros("ts").alias("us"), F.concat(spoken, F.lit(" "), F.col("event_type")).alias("text"))


SQL["messages"] = (
    "messages as (select event_id, user_id, epoch_us(ts) as us, ["
    + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES)
    + f"][(event_id % {len(SENTENCES)} + 1)::int] || ' ' || event_type as text from events)"
)
