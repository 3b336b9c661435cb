"""Queries of feedback, attribution, voting, policies and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import feedback
from ..operators.stats import when_count
from ..registry import query
from ..sources import views
from ..sources.views import sql

_REWARD = "case outcome when 'success' then 1.0 when 'partial' then 0.5 else -1.0 end"


def _attribution_sql(weight: str) -> str:
    return sql(f"""+w as (select *, {weight} as w from (select *, row_number() over (partition by outcome_id order by retrieved_us desc, retrieval_id desc) as r from links))
select outcome_id, retrieval_id, round(w / sum(w) over (partition by outcome_id) * {_REWARD}, 6) as credit from w""", "feedback")


def _attribution(method: str):
    def run(spark, sf_dir):
        return feedback.attribute(views.feedback(spark, sf_dir)[2], method)

    run.__name__ = f"attribution_{method}"
    return run


for _method, _weight in {"linear": "1.0", "last": "case when r = 1 then 1.0 else 0.0 end", "decay": "pow(2.0, -((outcome_us - retrieved_us) / 3.6e9))", "rank": "1.0 / r"}.items():
    query(_attribution_sql(_weight))(_attribution(_method))

_NET = """net as (select entry_id, floor(sum(case outcome when 'success' then 1.0 when 'partial' then 0.5 else 0.0 end) + 0.5)::bigint as positive, floor(sum(case outcome when 'failure' then 1.0 else 0.0 end) + 0.5)::bigint as negative from links group by 1)"""


@query(sql(f"+{_NET} select *, positive - negative as net, round(case when positive > negative then 1 + least(0.02 * positive, 0.1) when positive < negative then 1 - least(0.1 * (negative - positive), 0.5) else 1.0 end::double, 6) as multiplier from net", "feedback"))
def feedback_net(spark, sf_dir):
    net = feedback.net_feedback(views.feedback(spark, sf_dir)[2])
    return net.withColumn("multiplier", F.round(scoring.feedback_multiplier(F.col("positive"), F.col("net")), 6))


@query(sql("select entry_type, count(*) as n, count(*) filter (where outcome = 'success') as success, count(*) filter (where outcome = 'partial') as partial_, count(*) filter (where outcome = 'failure') as failure, round((count(*) filter (where outcome = 'success') + 0.5 * count(*) filter (where outcome = 'partial')) / count(*), 6) as rate from links group by 1", "feedback"))
def outcomes_by_type(spark, sf_dir):
    kinds = {"success": "success", "partial_": "partial", "failure": "failure"}
    by = views.feedback(spark, sf_dir)[2].groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), *[when_count(F.col("outcome") == v).alias(k) for k, v in kinds.items()])
    return by.withColumn("rate", F.round((F.col("success") + 0.5 * F.col("partial_")) / F.col("n"), 6))


@query(sql("""select entry_id, round(least(2.0, greatest(0.5, 1 - conf + (1 + (rate - 0.5)) * conf)), 6) as weight from (
 select entry_id, rate, case when n < 10 then 0.0 when n >= 100 then 1.0 else n / 100.0 end as conf from (select entry_id, count(*) as n, (count(*) filter (where outcome = 'success') + 0.5 * count(*) filter (where outcome = 'partial')) / count(*) as rate from links group by 1))""", "feedback"))
def adaptive_weights(spark, sf_dir):
    ok = when_count(F.col("outcome") == "success") + 0.5 * when_count(F.col("outcome") == "partial")
    by = views.feedback(spark, sf_dir)[2].groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), (ok / F.count(F.lit(1))).alias("rate"))
    return by.select("entry_id", F.round(scoring.adaptive_weight(F.col("rate"), F.col("n")), 6).alias("weight"))


_AS_OF_US = 1706745600000000


@query(sql(f"""select entry_id, round(case when n < 2 then 0.5 else 0.5 * good / n + 0.2 * exp(-ln(2.0) * (({_AS_OF_US} - last_us) / 86400e6) / 30) + 0.3 * least(1.0, n / 50.0) end, 6) as usefulness
 from (select entry_id, count(*) as n, count(*) filter (where outcome = 'success') as good, max(retrieved_us) as last_us from links group by 1)""", "feedback"))
def usefulness(spark, sf_dir):
    by = views.feedback(spark, sf_dir)[2].groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), when_count(F.col("outcome") == "success").alias("good"), F.max("retrieved_us").alias("last_us"))
    days = (F.lit(_AS_OF_US) - F.col("last_us")) / 86400e6
    return by.select("entry_id", F.round(scoring.usefulness(F.col("good"), F.col("n"), days), 6).alias("usefulness"))


@query(sql(f"""+{_NET}, s as (select e.entry_id, 20.0 + case when entry_type = 'guideline' then priority * 0.2 else 0.0 end + exp(-ln(2.0) * ((744 - born_h) / 24.0) / 30.0) * 10.0 as base, coalesce(positive, 0) as p, coalesce(positive - negative, 0) as net from entries e left join net n on n.entry_id = e.entry_id where is_active)
select entry_id, round(base * case when net > 0 then 1 + least(0.02 * p, 0.1) when net < 0 then 1 - least(0.1 * abs(net), 0.5) else 1.0 end, 6) as score from s order by score desc, entry_id limit 40""", "entries", "feedback"))
def feedback_scored_search(spark, sf_dir):
    net = feedback.net_feedback(views.feedback(spark, sf_dir)[2]).select("entry_id", "positive", "net")
    rows = views.entries(spark, sf_dir).filter("is_active").join(net, "entry_id", "left")
    base = 20.0 + F.when(F.col("entry_type") == "guideline", F.col("priority") * 0.2).otherwise(0.0) + scoring.recency((F.lit(views.AS_OF_HOURS) - F.col("born_h")) / 24.0)
    m = scoring.feedback_multiplier(F.coalesce("positive", F.lit(0)), F.coalesce("net", F.lit(0)))
    return rows.select("entry_id", F.round(base * m, 6).alias("score")).orderBy(F.desc("score"), "entry_id").limit(40)


_LATEST = "latest as (select * from votes qualify row_number() over (partition by task_id, agent_id order by event_id desc) = 1)"


@query(sql(f"""+{_LATEST}, c as (select task_id, vote, count(*) as n, sum(confidence) as c from latest group by all),
r as (select *, row_number() over (partition by task_id order by n desc, vote) as place, sum(n) over (partition by task_id) as every, sum(c) over (partition by task_id) as conf, count(*) over (partition by task_id) as options from c)
select a.task_id, a.vote, a.n as votes, coalesce(b.n, 0) as second, a.options = 1 or a.n - coalesce(b.n, 0) >= 3 as agreed, round(a.conf / a.every, 6) as confidence from r a left join r b on a.task_id = b.task_id and b.place = 2 where a.place = 1""", "votes"))
def vote_consensus(spark, sf_dir):
    return feedback.consensus(feedback.latest_votes(views.votes(spark, sf_dir)), 3)


@query(sql(f"+{_LATEST} select task_id, vote, count(*) as n, round(count(*) / sum(count(*)) over (partition by task_id), 6) as share from latest group by task_id, vote", "votes"))
def vote_distribution(spark, sf_dir):
    latest = feedback.latest_votes(views.votes(spark, sf_dir))
    by = latest.groupBy("task_id", "vote").agg(F.count(F.lit(1)).alias("n"))
    total = latest.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"))
    return by.join(total, "task_id").select("task_id", "vote", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(sql("""+s as (select agent_id, task_id, max((vote = 'error')::int) as wrong from votes group by all), t as (select agent_id, count(*) as tasks, sum(wrong) as errors from s group by 1),
p as (select x.agent_id as a, y.agent_id as b, count(*) as shared, sum(x.wrong * y.wrong)::bigint as joint from s x join s y on x.task_id = y.task_id and x.agent_id < y.agent_id group by all),
q as (select a, b, joint, ta.tasks + tb.tasks - shared as n, ta.errors as ea, tb.errors as eb from p join t ta on ta.agent_id = a join t tb on tb.agent_id = b)
select a, b, joint as "both", n as union, round(case when ea * (n - ea) * eb * (n - eb) = 0 then 0.0 else least(1.0, greatest(-1.0, (n * joint - ea * eb) / sqrt((ea * (n - ea) * eb * (n - eb))::double))) end, 6) as correlation from q""", "votes").replace("as union,", 'as "union",'))
def agent_error_corr(spark, sf_dir):
    return feedback.agent_error_correlation(views.votes(spark, sf_dir), F.col("vote") == "error")


@query(sql("""+a as (select entry_id as id, row_number() over (order by priority desc, entry_id) as rank from entries where is_active qualify rank <= 100), b as (select entry_id as id, row_number() over (order by access_count desc, entry_id) as rank from entries where is_active qualify rank <= 100)
select id, round(sum(1.0 / (60 + rank)), 9) as score from (select * from a union all select * from b) group by 1""", "entries"))
def rrf_merge(spark, sf_dir):
    """Two ranked lists of a hundred, each found by a bounded top-k before it is numbered."""
    from pyspark.sql import Window

    rows = views.entries(spark, sf_dir).filter("is_active")

    def ranked(by: str):
        head = rows.orderBy(F.desc(by), "entry_id").limit(100)
        return head.select(F.col("entry_id").alias("id"), F.row_number().over(Window.orderBy(F.desc(by), "entry_id")).alias("rank"))

    return feedback.fused(ranked("priority").unionByName(ranked("access_count")))


@query("""with r as (select event_id as id, user_id, event_type, value from events), s as (select user_id || ':' || event_type as state, id, value from r),
b as (select state, max(value) as hi, min(value) as lo from s group by 1)
select b.state, (select min(id) from s where s.state = b.state and value = hi) as chosen, (select min(id) from s where s.state = b.state and value = lo) as rejected, round(hi - lo, 6) as margin from b where hi - lo > 0.1""")
def dpo_pairs(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("state"), F.col("event_id").alias("id"), "value")
    return feedback.preference_pairs(rows, "state")


@query("select event_id as id, substr(sha256(event_id::varchar), 1, 1) in ('0', '1', '2') as is_eval from events where event_type in ('purchase', 'view')")
def train_eval_split(spark, sf_dir):
    """A split by hash of the id: three sixteenths for evaluation, the same in every run."""
    rows = views.table(spark, sf_dir, "events").filter("event_type in ('purchase', 'view')")
    return rows.select(F.col("event_id").alias("id"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 1).isin("0", "1", "2").alias("is_eval"))


@query("""select event_id, case when event_type = 'error' then -0.5 when value > 400 then 1.0 when value > 200 then 0.6 when event_type = 'signup' then 0.3 else 0.1 end::double as reward from events""")
def reward_steps(spark, sf_dir):
    v, kind = F.col("value"), F.col("event_type")
    value = F.when(kind == "error", -0.5).when(v > 400, 1.0).when(v > 200, 0.6).when(kind == "signup", 0.3).otherwise(0.1)
    return views.table(spark, sf_dir, "events").select("event_id", value.alias("reward"))


@query(sql("""select entry_id, case when not is_active then 'skip' when access_count >= 15 then 'keep' when (744 - born_h) / 24.0 > 25 and access_count < 5 then 'archive' when length(content) > 8000 then 'abstract' when access_count < 3 then 'merge' else 'keep' end as action from entries""", "entries"))
def policy_consolidation(spark, sf_dir):
    """An ordered decision table."""
    age = (F.lit(views.AS_OF_HOURS) - F.col("born_h")) / 24.0
    n = F.col("access_count")
    action = (
        F.when(~F.col("is_active"), "skip").when(n >= 15, "keep").when((age > 25) & (n < 5), "archive")
        .when(F.length("content") > 8000, "abstract").when(n < 3, "merge").otherwise("keep")
    )
    return views.entries(spark, sf_dir).select("entry_id", action.alias("action"))


@query(sql("""select entry_type, band, count(*) as n, round(least(1.0, count(*) / 10.0), 6) as confidence from (select entry_type, case when access_count >= 15 then 'high' when access_count = 0 and (744 - born_h) / 24.0 > 14 then 'low' end as band from entries) where band is not null group by all having count(*) >= 3""", "entries"))
def retrieval_value_patterns(spark, sf_dir):
    age = (F.lit(views.AS_OF_HOURS) - F.col("born_h")) / 24.0
    band = F.when(F.col("access_count") >= 15, "high").when((F.col("access_count") == 0) & (age > 14), "low")
    by = views.entries(spark, sf_dir).select("entry_type", band.alias("band")).filter("band is not null").groupBy("entry_type", "band")
    return by.agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 10.0), 6))


@query()
def bootstrap_mean(spark, sf_dir):
    """A percentile interval of a mean: Poisson resampling with hash-seeded draws, so reruns agree; tests check its coverage."""
    rows = views.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "value")
    draws = rows.select("value", "event_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"))
    u = F.pmod(F.xxhash64("event_id", "k"), F.lit(1_000_000)) / 1e6
    # a Poisson(1) count by its cumulative probabilities
    count = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    means = draws.withColumn("c", count).groupBy("k").agg((F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("m"))
    return means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.count(F.lit(1)).alias("resamples"))
