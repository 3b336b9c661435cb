"""Queries of ordered events, sessions, sequences and streams."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import sequence
from ..registry import query
from ..sources import views

_STEPS = "steps as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events)"


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _steps(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return views.table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order).cast("long"))


def _timed(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", views.micros("ts").alias("us"))


@query(f"""with {_STEPS}, a as (select user_id, min(n) as i from steps where event_type = 'view' group by 1), b as (select user_id, i, min(n) as j from steps join a using (user_id) where event_type = 'error' and n > i group by all)
select user_id, i, j, min(n) as k from steps join b using (user_id) where event_type = 'view' and n > j group by all""")
def seq_three_step(spark, sf_dir):
    """view ... error ... view."""
    return sequence.first_pattern(_steps(spark, sf_dir), _is("view"), _is("error"), _is("view"))


@query(f"with {_STEPS}, l as (select *, lead(event_type, 1) over w as a, lead(event_type, 2) over w as b from steps window w as (partition by user_id order by n)) select user_id, n, (case when a = 'purchase' then 1 else 2 end)::int as gap from l where event_type = 'click' and (a = 'purchase' or b = 'purchase')")
def seq_build_then_test(spark, sf_dir):
    """click, then purchase within two events."""
    return sequence.follows_within(_steps(spark, sf_dir), _is("click"), _is("purchase"), 2)


@query(f"""with {_STEPS}, m as (select *, sum(case when event_type in ('click', 'view') then 0 else 1 end) over (partition by user_id order by n rows unbounded preceding) as island from steps)
select user_id, min(n) as first, max(n) as last, count(*) as hits from m where event_type = 'click' group by user_id, island having count(*) >= 3""".replace("as first, max(n) as last,", 'as "first", max(n) as "last",'))
def islands_iterative_fix(spark, sf_dir):
    """Three or more clicks with only views among them."""
    return sequence.islands(_steps(spark, sf_dir), _is("click"), _is("view"), 3)


@query("select user_id, props as target, count(*) as edits, min(event_id) as first_id, max(event_id) as last_id from events where event_type = 'click' group by all having count(*) >= 2")
def retry_variant(spark, sf_dir):
    clicks = views.table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy("user_id", F.col("props").alias("target"))
    return clicks.agg(F.count(F.lit(1)).alias("edits"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).filter("edits >= 2")


@query(f"with {_STEPS} select user_id, max(n) filter (where event_type = 'view') as looked, max(n) filter (where event_type = 'purchase') as acted from steps group by 1 having max(n) filter (where event_type = 'view') < max(n) filter (where event_type = 'purchase')")
def seq_investigation(spark, sf_dir):
    """The last look came before the last action."""
    last = lambda kind: F.max(F.when(_is(kind), F.col("n")))
    return _steps(spark, sf_dir).groupBy("user_id").agg(last("view").alias("looked"), last("purchase").alias("acted")).filter("looked < acted")


@query(f"with {_STEPS}, l as (select event_type as before, lead(event_type) over (partition by user_id order by n) as after from steps) select before, after, count(*) as n from l where after is not null group by all")
def tool_transitions(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("before"), F.lead("event_type").over(order).alias("after"))
    return rows.filter("after is not null").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("""with l as (select user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap_us from events) select * from l where gap_us > 36000000000""")
def boundaries_timegap(spark, sf_dir):
    return sequence.time_gaps(_timed(spark, sf_dir), 36_000_000_000)


@query("""with l as (select user_id, epoch_us(ts) as us, event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 7200000000)::int, 1) as s from events),
g as (select *, sum(s) over (partition by user_id order by us, event_id rows unbounded preceding) as k from l) select user_id, min(us) as first_us, max(us) as last_us, count(*) as n from g group by user_id, k""")
def sessions(spark, sf_dir):
    return sequence.sessions(_timed(spark, sf_dir), 7_200_000_000)


@query("""with l as (select conv_id, max(turn) as last from conversations group by 1), w as (select conv_id, last, unnest(range(0, last + 1, 3)) as start from l)
select conv_id, start, least(start + 4, last) as stop from w where least(start + 4, last) - start + 1 - case when start > 0 then 2 else 0 end >= 2""")
def incremental_windows(spark, sf_dir):
    return sequence.turn_windows(views.table(spark, sf_dir, "conversations"), 5, 2, 2)


@query("""with s as (select user_id, event_id, value, avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as recent, avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and 5 preceding) as before, row_number() over (partition by user_id order by ts, event_id) as n from events)
select user_id, event_id, round(recent, 6) as recent, round(before, 6) as before from s where n >= 10 and abs(recent - before) > 60""")
def shifting_means(spark, sf_dir):
    """The last five against the five before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = views.table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.avg("value").over(order.rowsBetween(-4, 0)).alias("recent"), F.avg("value").over(order.rowsBetween(-9, -5)).alias("before"), F.row_number().over(order).alias("n")
    )
    return rows.filter("n >= 10 and abs(recent - before) > 60").select("user_id", "event_id", F.round("recent", 6).alias("recent"), F.round("before", 6).alias("before"))


@query("select epoch_us(time_bucket(interval 6 hours, ts)) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark, sf_dir):
    """Six-hour windows per type, by a watermarked stream over the event files that is drained."""
    from ..streaming.windows import windowed_totals

    return windowed_totals(spark, f"{sf_dir}/events.parquet")


@query("select user_id, event_type, count(*) as n, max(epoch_us(ts)) as last_us from events group by all")
def stream_counters(spark, sf_dir):
    """Counts per user and type, kept as the state of a stream."""
    from ..streaming.windows import running_counters

    return running_counters(spark, f"{sf_dir}/events.parquet")


@query("""with l as (select user_id, epoch_us(ts) as us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 1800000000)::int, 1) as s, event_id from events),
g as (select *, sum(s) over (partition by user_id order by us, event_id rows unbounded preceding) as k from l) select user_id, min(us) as first_us, max(us) as last_us, count(*) as n from g group by user_id, k""")
def session_spans(spark, sf_dir):
    """Sessions of thirty quiet minutes, by session windows."""
    from ..streaming.windows import session_spans as spans

    events = views.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return spans(events)


@query()
def episode_boundaries(spark, sf_dir):
    """Boundaries between episodes, by a stateful stream; tests compare with the rule in plain Python."""
    from ..streaming.boundaries import episode_boundaries as found

    return found(spark, f"{sf_dir}/events.parquet")


@query()
def episode_boundaries_similar(spark, sf_dir):
    """Boundaries where what is done changes in kind, even if some of it goes on; tests compare with the rule in plain Python."""
    from ..streaming.boundaries import episode_boundaries as found

    return found(spark, f"{sf_dir}/events.parquet", by_similarity=True, about="event_type")


_FIRST_TWO = "select user_id, i, min(n) as j from steps join (select user_id, min(n) as i from steps where event_type = 'view' group by 1) using (user_id) where event_type = 'click' and n > i group by all"


@query(f"with {_STEPS} {_FIRST_TWO}")
def seq_config_discovery(spark, sf_dir):
    """The first look that an edit follows, and that edit."""
    return sequence.first_pair(_steps(spark, sf_dir), _is("view"), _is("click"))


@query("""with c as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, json_extract_string(props, '$.k')::int as cmd from events where event_type = 'purchase'),
p as (select x.user_id, x.k as i, y.k as j from c x join c y on x.user_id = y.user_id and x.cmd % 7 = y.cmd % 7 and x.cmd <> y.cmd and y.k >= x.k + 2)
select user_id, i, min(j) as j from p where (user_id, i) in (select user_id, min(i) from p group by user_id) group by user_id, i""")
def seq_dependency_chain(spark, sf_dir):
    """A command, and the same command with other arguments after at least one other command."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cmd = F.get_json_object("props", "$.k").cast("int")
    rows = views.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", F.row_number().over(order).cast("long").alias("k"), cmd.alias("command"), (cmd % 7).alias("base"))
    return sequence.repeated_command(rows)


@query()
def trajectory_similarity(spark, sf_dir):
    """Each user's day against their next one: step order, step sets, length; tests compare with brute force."""
    return sequence.trajectory_similarity(views.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type"))


# How sure each detector is.
_CONFIDENCE = {
    "seq_three_step": ("stale_code", 0.85), "seq_config_discovery": ("config_discovery", 0.8), "seq_dependency_chain": ("dependency_chain", 0.75), "retry_variant": ("retry_variant", 0.7),
    "seq_build_then_test": ("build_then_test", 0.85), "seq_investigation": ("investigation_success", 0.75), "islands_iterative_fix": ("iterative_fix", 0.7),
}
_LEAST = 0.75


def _observed_sql() -> str:
    from ..registry import ORACLES

    return " union all ".join(f"select distinct user_id, '{kind}' as pattern, {c}::double as confidence from ({ORACLES[name]})" for name, (kind, c) in _CONFIDENCE.items() if c >= _LEAST)


@query(_observed_sql())
def observed_behaviours(spark, sf_dir):
    """The patterns that each session shows, of detectors that are sure enough."""
    from ..registry import QUERIES

    out = None
    for name, (kind, confidence) in _CONFIDENCE.items():
        if confidence >= _LEAST:
            one = QUERIES[name](spark, sf_dir).select("user_id").distinct().select("user_id", F.lit(kind).alias("pattern"), F.lit(confidence).alias("confidence"))
            out = one if out is None else out.unionByName(one)
    return out


@query()
def session_behaviours(spark, sf_dir):
    """What each session showed when it ended, by a stateful stream over a buffer of its last hundred steps; tests compare with the plain rule.

    A session ends after a day of silence and its buffer goes back a week, since the given events are some hours apart.
    """
    from ..streaming import observer

    day = 86_400_000_000
    return observer.observed(spark, f"{sf_dir}/events.parquet", observer.Limits(expiry_us=7 * day, quiet_us=day))
