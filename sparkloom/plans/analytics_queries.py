"""Queries of usage analytics, statistics and rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators.stats import nearest_rank, top, when_count
from ..registry import query
from ..sources import views
from ..sources.views import sql


@query(sql("select entry_id, entry_type, count(*) as n from audit_log where action = 'query' and entry_id is not null group by all order by n desc, entry_id, entry_type limit 20", "audit_log"))
def usage_most_queried(spark, sf_dir):
    log = views.audit_log(spark, sf_dir).filter("action = 'query' and entry_id is not null")
    return top(log.groupBy("entry_id", "entry_type").agg(F.count(F.lit(1)).alias("n")), 20, "n", "entry_id", "entry_type")


@query(sql("select strftime(ts, '%Y-%m-%d') as day, count(*) as n from audit_log where action = 'query' group by 1 order by day desc limit 30", "audit_log"))
def usage_daily(spark, sf_dir):
    log = views.audit_log(spark, sf_dir).filter("action = 'query'")
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(30)


@query(sql("select tag, count(*) as n from entry_tags group by 1 order by n desc, tag limit 20", "entry_tags"))
def usage_tag_popularity(spark, sf_dir):
    return top(views.entry_tags(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n")), 20, "n", "tag")


@query(sql("select k.scope_type, count(a.event_id) as n from (values ('global'), ('org'), ('project'), ('session')) k(scope_type) left join audit_log a on a.scope_type = k.scope_type and a.action = 'query' group by 1", "audit_log"))
def usage_scope(spark, sf_dir):
    """Zero-filled over the four scope types."""
    log = views.audit_log(spark, sf_dir).filter("action = 'query'").groupBy("scope_type").agg(F.count(F.lit(1)).alias("n"))
    keys = spark.createDataFrame([(s,) for s in views.SCOPES], "scope_type string")
    return keys.join(log, "scope_type", "left").select("scope_type", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql("select lower(trim(json_extract_string(query_params, '$.k'))) as term, count(*) as n from audit_log where json_extract_string(query_params, '$.k') is not null group by 1 order by n desc, term limit 20", "audit_log"))
def usage_search_terms(spark, sf_dir):
    term = F.lower(F.trim(F.get_json_object("query_params", "$.k")))
    return top(views.audit_log(spark, sf_dir).select(term.alias("term")).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n")), 20, "n", "term")


@query(sql("select 'action' as kind, action as name, count(*) as n from audit_log group by all union all select 'entry_type', entry_type, count(*) from audit_log group by all", "audit_log"))
def usage_breakdown(spark, sf_dir):
    log = views.audit_log(spark, sf_dir)
    by = lambda kind: log.groupBy(F.col(kind).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by("action").unionByName(by("entry_type"))


@query(sql("""select strftime(ts, '%Y-%m-%d') as day, count(*) filter (where action = 'query') as queries, count(*) filter (where action = 'create') as creates,
 count(*) filter (where action = 'update') as updates, count(*) filter (where action = 'delete') as deletes, count(*) as total from audit_log group by 1 order by day desc limit 30""", "audit_log"))
def usage_trends_pivot(spark, sf_dir):
    kinds = {"queries": "query", "creates": "create", "updates": "update", "deletes": "delete"}
    by = views.audit_log(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return by.agg(*[when_count(F.col("action") == a).alias(name) for name, a in kinds.items()], F.count(F.lit(1)).alias("total")).orderBy(F.desc("day")).limit(30)


@query(sql("""select subtask_type, count(*) as total, count(*) filter (where success) as succeeded, count(*) filter (where not success) as failed,
 round(count(*) filter (where success) / count(success), 6) as rate, round(avg(execution_time), 6) as avg_time from audit_log where subtask_type is not null group by 1""", "audit_log"))
def subtask_stats(spark, sf_dir):
    log = views.audit_log(spark, sf_dir).filter("subtask_type is not null").groupBy("subtask_type")
    ok, bad = when_count(F.col("success")), when_count(~F.col("success"))
    return log.agg(F.count(F.lit(1)).alias("total"), ok.alias("succeeded"), bad.alias("failed"), F.round(ok / F.count("success"), 6).alias("rate"), F.round(F.avg("execution_time"), 6).alias("avg_time"))


_TOOLS = "tools as (select event_type as tool, event_type <> 'error' and value < 400 as ok, case when event_id % 4 <> 0 then value end as ms from events)"


def _tools(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool"), ((F.col("event_type") != "error") & (F.col("value") < 400)).alias("ok"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("ms")
    )


@query(f"with {_TOOLS} select tool, count(*) as n, round(count(*) filter (where ok) / count(*), 6) as rate, round(coalesce(sum(ms), 0) / count(*), 6) as avg_ms, round(avg(ms), 6) as avg_timed_ms from tools group by tool")
def tool_stats(spark, sf_dir):
    n = F.count(F.lit(1))
    return _tools(spark, sf_dir).groupBy("tool").agg(
        n.alias("n"), F.round(when_count(F.col("ok")) / n, 6).alias("rate"), F.round(F.coalesce(F.sum("ms"), F.lit(0.0)) / n, 6).alias("avg_ms"), F.round(F.avg("ms"), 6).alias("avg_timed_ms")
    )


@query(f"with {_TOOLS} select floor(100 * (0.7 * (count(*) filter (where ok) / count(*)) + 0.3 * (1 - count(*) filter (where tool = 'error') / count(*))) + 0.5)::bigint as health from tools")
def health_score(spark, sf_dir):
    n = F.count(F.lit(1))
    value = 100 * (0.7 * (when_count(F.col("ok")) / n) + 0.3 * (1 - when_count(F.col("tool") == "error") / n))
    return _tools(spark, sf_dir).agg(scoring.half_up(value).alias("health"))


@query("""select severity, event_type as kind, count(*) as n, round(count(*) filter (where event_type = 'error') / count(*), 6) as error_rate
 from (select *, case when value >= 300 then 'high' when value >= 100 then 'medium' else 'low' end as severity from events) group by all""")
def notification_stats(spark, sf_dir):
    level = F.when(F.col("value") >= 300, "high").when(F.col("value") >= 100, "medium").otherwise("low")
    by = views.table(spark, sf_dir, "events").groupBy(level.alias("severity"), F.col("event_type").alias("kind"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(when_count(F.col("event_type") == "error") / F.count(F.lit(1)), 6).alias("error_rate"))


@query(sql("""select category, n, entry_id, place from (select category, entry_id, row_number() over (partition by category order by priority desc, entry_id)::int as place, count(*) over (partition by category) as n from entries where is_active) where place <= 3""", "entries"))
def category_topn(spark, sf_dir):
    """Counts and the first three of each category; the leaders are found by a bounded aggregate, not a sort of the category."""
    rows = views.entries(spark, sf_dir).filter("is_active")
    first = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("priority"), "entry_id")
    ranked = rows.select("category", "entry_id", "priority").withColumn("place", F.row_number().over(w)).filter("place <= 3")
    return ranked.join(first, ranked["category"].eqNullSafe(first["category"])).select(ranked["category"], "n", "entry_id", "place")


@query("select props as signature, user_id, count(*) as n, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us from events where event_type = 'error' group by all")
def error_rollup(spark, sf_dir):
    errors = views.table(spark, sf_dir, "events").filter("event_type = 'error'")
    us = views.micros("ts")
    return errors.groupBy(F.col("props").alias("signature"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("select props as signature, count(distinct user_id) as sessions, count(*) as n from events where event_type = 'error' and ts >= timestamp '2024-01-08' group by 1 having count(distinct user_id) >= 3")
def cross_session_errors(spark, sf_dir):
    errors = views.table(spark, sf_dir, "events").filter("event_type = 'error' and ts >= timestamp '2024-01-08 00:00:00'")
    by = errors.groupBy(F.col("props").alias("signature")).agg(F.countDistinct("user_id").alias("sessions"), F.count(F.lit(1)).alias("n"))
    return by.filter("sessions >= 3")


@query("""select conv_id, count(*) as messages, count(*) filter (where role = 'user') as by_user, count(*) filter (where role = 'assistant') as by_agent,
 max(turn) - min(turn) as span, round(avg(length(text)), 6) as avg_chars from conversations group by 1""")
def conversation_analytics(spark, sf_dir):
    by = views.table(spark, sf_dir, "conversations").groupBy("conv_id")
    return by.agg(
        F.count(F.lit(1)).alias("messages"), when_count(F.col("role") == "user").alias("by_user"), when_count(F.col("role") == "assistant").alias("by_agent"),
        (F.max("turn") - F.min("turn")).alias("span"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"),
    )


_TABLES = ("documents", "embeddings", "events", "conversations", "labels", "pages", "benchmark", "customer", "nation", "region")


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _TABLES))
def table_counts(spark, sf_dir):
    out = None
    for name in _TABLES:
        one = views.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("""select k.entry_type, count(e.entry_id) as entries, count(distinct v.vec_id) as covered, round(case when count(e.entry_id) = 0 then 1.0 else count(distinct v.vec_id) / count(e.entry_id) end, 6) as ratio
 from (values ('tool'), ('guideline'), ('knowledge'), ('experience')) k(entry_type) left join entries e on e.entry_type = k.entry_type and e.is_active left join embeddings v on v.vec_id = e.entry_id group by 1""", "entries"))
def embedding_coverage(spark, sf_dir):
    rows = views.entries(spark, sf_dir).filter("is_active").join(views.table(spark, sf_dir, "embeddings").select(F.col("vec_id")), F.col("entry_id") == F.col("vec_id"), "left")
    by = rows.groupBy("entry_type").agg(F.count("entry_id").alias("entries"), F.countDistinct("vec_id").alias("covered"))
    keys = spark.createDataFrame([(t,) for t in views.TYPES], "entry_type string")
    n, c = F.coalesce("entries", F.lit(0)), F.coalesce("covered", F.lit(0))
    return keys.join(by, "entry_type", "left").select("entry_type", n.alias("entries"), c.alias("covered"), F.round(F.when(n == 0, 1.0).otherwise(c / n), 6).alias("ratio"))


@query(sql("select vec_id, label from embeddings where vec_id not in (select entry_id from entries where is_active)", "entries"))
def orphan_embeddings(spark, sf_dir):
    live = views.entries(spark, sf_dir).filter("is_active").select(F.col("entry_id").alias("vec_id"))
    return views.table(spark, sf_dir, "embeddings").join(live, "vec_id", "left_anti").select("vec_id", "label")


@query("""with r as (select value from events where event_type = 'purchase')
select count(*) as n, min(value) as low, max(value) as high, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as spread,
 list_sort(list(value))[(count(*) * 25 // 100 + 1)::int] as q1, list_sort(list(value))[(count(*) // 2 + 1)::int] as median, list_sort(list(value))[(count(*) * 75 // 100 + 1)::int] as q3 from r""")
def reward_distribution(spark, sf_dir):
    values = views.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("value")
    ranks = nearest_rank(values, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    moments = values.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"))
    return moments.withColumn("_k", F.lit(1)).join(ranks.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("""with b as (select min(value) as lo, max(value) as hi from events where event_type = 'purchase')
select least(9, floor((value - lo) / (hi - lo) * 10))::bigint as bin, count(*) as n from events, b where event_type = 'purchase' group by 1""")
def reward_histogram(spark, sf_dir):
    values = views.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("value")
    low, high = values.agg(F.min("value"), F.max("value")).first()
    bin_ = F.least(F.lit(9), F.floor((F.col("value") - F.lit(low)) / (F.lit(high) - F.lit(low)) * 10)).cast("long")
    return values.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_WEEK = 7 * 24 * 3600 * 1_000_000


@query(f"""with b as (select min(epoch_us(ts)) as t0 from events), w as (select (epoch_us(ts) - t0) // {_WEEK} as win, count(*) as n, round(avg(value), 6) as mean from events, b group by 1)
select win, n, mean, case when (select regr_slope(mean, win) from w) > 0.01 then 'improving' when (select regr_slope(mean, win) from w) < -0.01 then 'declining' else 'stable' end as trend from w""")
def temporal_trend(spark, sf_dir):
    """Weekly windows from the first event, and the least-squares trend of their means."""
    events = views.table(spark, sf_dir, "events").select(views.micros("ts").alias("us"), "value")
    t0 = events.agg(F.min("us")).first()[0]
    wins = events.groupBy(F.expr(f"(us - {t0 or 0}) div {_WEEK}").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    slope = wins.agg(F.regr_slope("mean", "win")).first()[0] or 0.0
    return wins.withColumn("trend", F.lit("improving" if slope > 0.01 else "declining" if slope < -0.01 else "stable"))


_JUDGED = "judged as (select doc_id, quality as actual, case when n_chars >= 600 then 1 else 0 end as expected from labels join documents using (doc_id))"


@query(f"with {_JUDGED} select expected, actual, count(*) as n from judged group by all")
def confusion_matrix(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def _judged(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 600, 1).otherwise(0).alias("expected"))
    return views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual")).join(docs, "doc_id")


@query(f"""with {_JUDGED}, c as (select expected, actual, count(*) as n from judged group by all),
p as (select k as class, coalesce(sum(n) filter (where expected = k and actual = k), 0) as tp, coalesce(sum(n) filter (where expected <> k and actual = k), 0) as fp, coalesce(sum(n) filter (where expected = k and actual <> k), 0) as fn from c, (values (0), (1)) v(k) group by k)
select class, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall,
 round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1, (tp + fn)::bigint as support from p""")
def class_metrics(spark, sf_dir):
    """Precision, recall and F1 of each class, from the confusion counts."""
    one = _judged(spark, sf_dir).groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))
    both = one.select("expected", "actual", "n", F.explode(F.array_distinct(F.array("expected", "actual"))).alias("class"))
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    k = F.col("class")
    by = both.groupBy("class").agg(
        hit((F.col("expected") == k) & (F.col("actual") == k)).alias("tp"), hit((F.col("expected") != k) & (F.col("actual") == k)).alias("fp"), hit((F.col("expected") == k) & (F.col("actual") != k)).alias("fn")
    )
    part = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return by.select("class", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


@query("""with s as (select event_type, count(*) as n, avg(value) as m, var_samp(value) as v from events where event_type in ('view', 'click') group by 1), a as (select * from s where event_type = 'view'), b as (select * from s where event_type = 'click')
select round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) as t, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) as cohens_d from a, b""")
def welch_test(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").filter("event_type in ('view', 'click')")
    side = lambda kind, f, name: f(F.when(F.col("event_type") == kind, F.col("value"))).alias(name)
    one = rows.agg(*[side(kind, f, name + tail) for kind, tail in (("view", "a"), ("click", "b")) for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    t = "(ma - mb) / sqrt(va / na + vb / nb)"
    return one.select(F.round(F.expr(t), 6).alias("t"), F.round(F.expr("(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))"), 6).alias("cohens_d"))


@query(sql("""select least(floor(confidence * 10), 9)::bigint as bucket, count(*) as n, round(avg(confidence), 6) as expected, round(count(*) filter (where vote in ('purchase', 'signup')) / count(*), 6) as actual from votes group by 1""", "votes"))
def calibration(spark, sf_dir):
    bucket = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("long")
    by = views.votes(spark, sf_dir).groupBy(bucket.alias("bucket"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("expected"), F.round(when_count(F.col("vote").isin("purchase", "signup")) / F.count(F.lit(1)), 6).alias("actual"))


@query(sql("""select e.category as stored, case when e.priority >= 50 then 'src1' else 'src0' end as inferred, count(*) as n from entries e group by all""", "entries"))
def category_mismatch(spark, sf_dir):
    rows = views.entries(spark, sf_dir)
    return rows.groupBy(F.col("category").alias("stored"), F.when(F.col("priority") >= 50, "src1").otherwise("src0").alias("inferred")).agg(F.count(F.lit(1)).alias("n"))
