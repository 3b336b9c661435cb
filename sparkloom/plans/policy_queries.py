"""Queries of decision policies, priorities and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import maintenance, policies, vector
from ..operators.stats import when_count
from ..registry import query
from ..sources import views
from ..sources.views import sql

# A retrieval state for each user turn; an extraction state for each assistant turn.
_RETRIEVAL = """s as (select conv_id, turn, least(1.0, length(text) / 400.0) as complexity, contains(lower(text), 'the') as keywords, contains(text, '!') as errors, length(text) as len,
 (conv_id % 10) / 10.0 as success, conv_id % 7 as recent, turn as depth, conv_id % 5 as calls, conv_id % 11 as total from conversations where role = 'user')"""


@query(f"""with {_RETRIEVAL} select conv_id, turn, case when keywords and complexity > 0.6 then 'complex_query_with_keywords' when errors then 'error_recovery' when len < 20 and complexity < 0.3 and not keywords then 'simple_query'
 when success > 0.7 and recent > 0 then 'recent_success' when depth > 10 then 'deep_conversation' when calls > 3 then 'tool_heavy' when total = 0 or (success < 0.3 and recent > 5) then 'low_utility_memory' else 'default' end as reason from s""")
def policy_retrieval(spark, sf_dir):
    c = F.col
    rows = views.table(spark, sf_dir, "conversations").filter("role = 'user'")
    n = F.length("text")
    reason = policies.retrieval_policy(
        F.least(F.lit(1.0), n / 400.0), F.contains(F.lower("text"), F.lit("the")), F.contains("text", F.lit("!")), n,
        c("conv_id") % 10 / 10.0, c("conv_id") % 7, c("turn"), c("conv_id") % 5, c("conv_id") % 11,
    )
    return rows.select("conv_id", "turn", reason.alias("reason"))


@query("""with s as (select conv_id, turn, (conv_id + turn) % 13 = 0 as known, contains(text, '!') as error, contains(text, ';') as rule, contains(text, '`') as command, contains(lower(text), 'en ') as decision, contains(text, ':') as fact,
 (conv_id * 7 + turn) % 100 / 100.0 as novelty, least(1.0, length(text) / 400.0) as complexity, conv_id % 9 as captures from conversations where role = 'assistant')
select conv_id, turn, case when known then 'skip:duplicate_content' when error then 'store:error_occurred' when rule or command or (decision and novelty > 0.7) then 'store:strong_content_signal' when turn < 3 and not fact then 'defer:early_conversation'
 when novelty > 0.6 and complexity > 0.5 then 'store:high_novelty' when captures > 5 and novelty < 0.5 then 'skip:capture_rate_limit' else 'skip:low_value_content' end as decision from s""")
def policy_extraction(spark, sf_dir):
    c, has = F.col, lambda x: F.contains("text", F.lit(x))
    rows = views.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    decision = policies.extraction_policy(
        (c("conv_id") + c("turn")) % 13 == 0, has("!"), has(";"), has("`"), F.contains(F.lower("text"), F.lit("en ")), has(":"),
        (c("conv_id") * 7 + c("turn")) % 100 / 100.0, F.least(F.lit(1.0), F.length("text") / 400.0), c("turn"), c("conv_id") % 9,
    )
    return rows.select("conv_id", "turn", decision.alias("decision"))


_CONSOLIDATE = """case when low > 0.95 and size > 1 then 'dedupe:exact_duplicates' when retrievals = 0 and idle > 90 then 'archive:unused_old_entries' when success < 0.3 and idle > 60 and retrievals > 5 then 'archive:low_success_old_entries'
 when mean > 0.8 and retrievals < 10 and size >= 2 then 'merge:similar_low_usage' when size >= 5 and retrievals > 50 and success > 0.6 then 'abstract:pattern_abstraction' when mean > 0.7 and types = 1 and size >= 3 then 'merge:similar_same_type' else 'keep:default' end"""


@query(sql(f"""+g as (select category, lang, count(*) as size, sum(access_count) as retrievals, max(coalesce(access_lag_h, 999)) / 2.0 as idle, avg((priority >= 50)::int) as success, count(distinct entry_type) as types,
 min(priority) / 100.0 + 0.5 as low, avg(priority) / 100.0 + 0.35 as mean from entries group by all) select category, lang, {_CONSOLIDATE} as decision from g""", "entries"))
def policy_consolidation_groups(spark, sf_dir):
    """The group policy over entries of one category and language."""
    g = views.entries(spark, sf_dir).groupBy("category", "lang").agg(
        F.count(F.lit(1)).alias("size"), F.sum("access_count").alias("retrievals"), (F.max(F.coalesce("access_lag_h", F.lit(999))) / 2.0).alias("idle"),
        F.avg((F.col("priority") >= 50).cast("int")).alias("success"), F.countDistinct("entry_type").alias("types"),
        (F.min("priority") / 100.0 + 0.5).alias("low"), (F.avg("priority") / 100.0 + 0.35).alias("mean"),
    )
    decision = policies.consolidation_policy(*[F.col(c) for c in ("low", "mean", "size", "retrievals", "idle", "success", "types")])
    return g.select("category", "lang", decision.alias("decision"))


@query(sql("""select entry_id, case when entry_id % 4 = 0 then 0.0 when entry_id % 4 >= 3 then 25.0 else floor(10.0 * (entry_id % 4) / 3 + 0.5) end::double as boost from entries""", "entries"))
def entity_boosts(spark, sf_dir):
    """The boost for hits of three entities."""
    return views.entries(spark, sf_dir).select("entry_id", policies.entity_boost(F.col("entry_id") % 4, F.lit(3)).alias("boost"))


@query(sql("""select entry_id, round(0.4 * (0.5 + priority / 100.0) + 0.3 * (access_count / 23.0) + 0.3 * case when access_count = 0 then 1.0 else 1 + least(1.0, access_count / 30.0) * 0.2 end, 6)::double as score from entries""", "entries"))
def smart_priority(spark, sf_dir):
    n = F.col("access_count")
    context = policies.context_boost(n / 1.0, F.lit(30.0))
    return views.entries(spark, sf_dir).select("entry_id", F.round(policies.smart_priority(0.5 + F.col("priority") / 100.0, n / 23.0, context), 6).alias("score"))


_INTENT_ROWS = ", ".join(f"('{i}', '{t}', {w})" for i, ws in policies.INTENT_TYPE_WEIGHTS.items() for t, w in ws.items())


@query(sql(f"""+w(intent, entry_type, weight) as (values {_INTENT_ROWS}) select intent, entry_id, round(priority * weight, 6)::double as score from entries join w using (entry_type) where is_active""", "entries"))
def intent_weighted(spark, sf_dir):
    """Each entry's priority under each of the six intents."""
    rows, out = views.entries(spark, sf_dir).filter("is_active"), None
    for name in policies.INTENT_TYPE_WEIGHTS:
        one = rows.select(F.lit(name).alias("intent"), "entry_id", F.round(F.col("priority") * policies.intent_weight(name, F.col("entry_type")), 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("""+one as (select v as q from vectors where vec_id = 0), s as (select vec_id, list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) as sim from vectors, one),
c as (select outcome_id, count(*) as n from links where outcome = 'success' group by 1), e as (select entry_id, sum(sim) as total from links join s on vec_id = outcome_id % 500 where outcome = 'success' and sim >= 0.1 group by 1),
t as (select count(*) as n from (select distinct outcome_id from links join s on vec_id = outcome_id % 500 where outcome = 'success' and sim >= 0.1))
select entry_id, round(case when n = 0 or total = 0 then 1.0 else 1 + least(1.0, total / n) * 0.2 end, 6)::double as boost from e, t""", "vectors", "feedback"))
def context_boosts(spark, sf_dir):
    """Entries that helped in contexts like the present one: similarity-weighted successes over the contexts found."""
    q = vector.literal(views.vectors(spark, sf_dir).filter("vec_id = 0").first()["v"])  # one row
    near = views.vectors(spark, sf_dir).select(F.col("vec_id").alias("context"), vector.cosine(F.col("v"), q).alias("sim")).filter("sim >= 0.1")
    links = views.feedback(spark, sf_dir)[2].filter("outcome = 'success'").select("outcome_id", "entry_id", (F.col("outcome_id") % 500).alias("context"))
    found = links.join(near, "context")
    contexts = found.agg(F.countDistinct("outcome_id")).first()[0]
    by = found.groupBy("entry_id").agg(F.sum("sim").alias("total"))
    return by.select("entry_id", F.round(policies.context_boost(F.col("total"), F.lit(float(contexts))), 6).alias("boost"))


@query(sql("""select category, case when count(*) < 2 then 'reject' when round(0.4 * avg(priority) / 100 + 0.2 * least(1.0, count(*) / 10.0) + 0.25 * avg(is_active::int) + 0.15 * avg((length(content) > 50)::int), 9) >= 0.9 then 'auto_promote'
 when round(0.4 * avg(priority) / 100 + 0.2 * least(1.0, count(*) / 10.0) + 0.25 * avg(is_active::int) + 0.15 * avg((length(content) > 50)::int), 9) >= 0.7 then 'review' else 'reject' end as disposition from entries where content is not null group by 1""", "entries"))
def quality_gate(spark, sf_dir):
    by = views.entries(spark, sf_dir).filter("content is not null").groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("priority").alias("p"), F.avg(F.col("is_active").cast("int")).alias("ok"), F.avg((F.length("content") > 50).cast("int")).alias("long")
    )
    gate = policies.quality_gate(F.col("p") / 100, F.least(F.lit(1.0), F.col("n") / 10.0), F.col("ok"), F.col("long"), F.col("n") >= 2)
    return by.select("category", gate.alias("disposition"))


@query(sql("select entry_id, ceil(length(content) * 0.25)::bigint as tokens, case when ceil(length(content) * 0.25) <= 1500 then 'none' when ceil(length(content) * 0.25) <= 3000 then 'hierarchical' else 'truncated' end as level from entries where content is not null", "entries"))
def compression_levels(spark, sf_dir):
    tokens = scoring.token_estimate(F.col("content"))
    return views.entries(spark, sf_dir).filter("content is not null").select("entry_id", tokens.alias("tokens"), policies.compression_level(tokens).alias("level"))


@query(sql("""select 'type' as part, entry_type as name, count(*) as n from entries where is_active group by 2 union all select 'category', category, count(*) from entries where is_active group by 2
union all select 'critical', entry_id::varchar, priority from (select entry_id, priority from entries where is_active and entry_type = 'guideline' and priority >= 90 order by priority desc, entry_id limit 5)
union all select 'recent', entry_id::varchar, born_h from (select entry_id, born_h from entries where is_active order by born_h desc, entry_id limit 5)""", "entries"))
def overview(spark, sf_dir):
    """Counts by type and category, the five most critical rules, the five newest entries."""
    rows = views.entries(spark, sf_dir).filter("is_active")
    count = lambda part, c: rows.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "name", "n")
    head = lambda part, frame, c: frame.orderBy(F.desc(c), "entry_id").limit(5).select(F.lit(part).alias("part"), F.col("entry_id").cast("string").alias("name"), F.col(c).alias("n"))
    critical = rows.filter("entry_type = 'guideline' and priority >= 90")
    return count("type", "entry_type").unionByName(count("category", "category")).unionByName(head("critical", critical, "priority")).unionByName(head("recent", rows, "born_h"))


@query(sql("""select entry_id, case when access_count >= 5 then 'strategy' else 'case' end as level, case when access_count >= 5 then 'skill' else 'strategy' end as next_level, round(case when access_count > 0 then (priority % (access_count + 1)) / access_count else 0 end, 6)::double as confidence
 from entries where entry_type = 'experience'""", "entries"))
def experience_levels(spark, sf_dir):
    """Confidence (successes over uses) of each experience and the level it can be promoted to."""
    level = F.when(F.col("access_count") >= 5, "strategy").otherwise("case")
    rate = F.when(F.col("access_count") > 0, (F.col("priority") % (F.col("access_count") + 1)) / F.col("access_count")).otherwise(0.0)
    rows = views.entries(spark, sf_dir).filter("entry_type = 'experience'")
    return rows.select("entry_id", level.alias("level"), policies.promoted(level).alias("next_level"), F.round(rate, 6).alias("confidence"))


@query(sql("""select entry_type, count(*) as n, count(*) filter (where reward > 0) as positive, round(avg(reward), 6) as mean, round(stddev_pop(reward), 6) as spread, min(reward) as low, max(reward) as high
 from (select retrievals.entry_type, (case outcome when 'success' then 1.0 when 'partial' then 0.5 else -1.0 end)::double as reward from links join retrievals using (retrieval_id)) group by 1""", "feedback"))
def reward_summary(spark, sf_dir):
    from ..operators import feedback

    rows = views.feedback(spark, sf_dir)[2].select("entry_type", feedback.reward(F.col("outcome")).alias("reward"))
    r = F.col("reward")
    return rows.groupBy("entry_type").agg(
        F.count(F.lit(1)).alias("n"), when_count(r > 0).alias("positive"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("spread"), F.min(r).alias("low"), F.max(r).alias("high")
    )


_QUOTA = maintenance.quotas({"guideline": 0.4, "knowledge": 0.3, "tool": 0.2, "experience": 0.1}, 20)


@query(sql(f"""+q(entry_type, places) as (values {', '.join(f"('{k}', {v})" for k, v in _QUOTA.items())}), r as (select entry_id, entry_type, row_number() over (partition by entry_type order by priority desc, entry_id) as place from entries where is_active)
select entry_id, r.entry_type, place::int as place from r join q using (entry_type) where place <= places""", "entries"))
def quota_injection(spark, sf_dir):
    """The best entries of each type up to its quota: one bounded top-k per type."""
    from pyspark.sql import Window

    rows, out = views.entries(spark, sf_dir).filter("is_active"), None
    for kind, places in _QUOTA.items():
        head = rows.filter(F.col("entry_type") == kind).orderBy(F.desc("priority"), "entry_id").limit(places)
        one = head.select("entry_id", "entry_type", F.row_number().over(Window.partitionBy("entry_type").orderBy(F.desc("priority"), "entry_id")).alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("""+s as (select vec_id, (vec_id * 13 % 50)::double as base, case when vec_id % 3 <> 0 then (vec_id * 29 % 100) / 100.0 end as judged from vectors), r as (select *, row_number() over (order by base desc, vec_id) as place from s)
select vec_id, round(0.6 * coalesce(judged, 0) + 0.4 * base, 6)::double as score from r where place <= 15""", "vectors"))
def cross_encoder_blend(spark, sf_dir):
    """The first fifteen get the blend of a judge's score and their own; a missing judgement counts as 0."""
    scored = views.vectors(spark, sf_dir).select("vec_id", (F.col("vec_id") * 13 % 50).cast("double").alias("base"), F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") * 29 % 100 / 100.0).alias("judged"))
    head = scored.orderBy(F.desc("base"), "vec_id").limit(15)
    return head.select("vec_id", F.round(0.6 * F.coalesce("judged", F.lit(0.0)) + 0.4 * F.col("base"), 6).alias("score"))
