"""Merges of ranked lists, two-phase ranking, pages by cursor, ordered enumerations, neighbours with filters, keys and choices."""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cursors, scoring
from ..operators import commands, fulltext, graph, signals
from ..registry import query
from ..sources import views
from ..sources.views import sql

LIMIT = 25
#: Hours of the given tables' "now".
AS_OF_HOURS = 744

_RESULTS = """results as (
 select 0 as idx, entry_id as id, priority / 100.0::double as score from (select * from entries where is_active order by priority desc, entry_id limit 60)
 union all select 1, entry_id, access_count / 22.0::double from (select * from entries where is_active order by access_count desc, entry_id limit 60)
 union all select 2, entry_id, born_h / 720.0::double from (select * from entries where is_active order by born_h desc, entry_id limit 60))"""


def _results(spark, sf_dir) -> DataFrame:
    """(idx, id, score): the results of three sub-queries, each by its own bounded top-k."""
    rows = views.entries(spark, sf_dir).filter("is_active")
    lists = [("priority", 100.0), ("access_count", 22.0), ("born_h", 720.0)]
    parts = [rows.orderBy(F.desc(c), "entry_id").limit(60).select(F.lit(k).alias("idx"), F.col("entry_id").alias("id"), (F.col(c) / top).alias("score")) for k, (c, top) in enumerate(lists)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merged(results: DataFrame, how: str) -> DataFrame:
    """(id, score) of sub-query results (idx, id, score): the largest score, the sum, or the sum weighted by 1 / (idx + 1)."""
    value = {"max": F.max("score"), "sum": F.sum("score"), "weighted": F.sum(F.col("score") / (F.col("idx") + 1))}[how]
    return results.groupBy("id").agg(F.round(value, 9).alias("score")).orderBy(F.desc("score"), "id").limit(LIMIT)


def _merge_sql(value: str) -> str:
    return sql(f"+{_RESULTS} select id, round({value}, 9) as score from results group by id order by score desc, id limit {LIMIT}", "entries")


@query(_merge_sql("max(score)"))
def merge_max(spark, sf_dir):
    return merged(_results(spark, sf_dir), "max")


@query(_merge_sql("sum(score)"))
def merge_sum(spark, sf_dir):
    return merged(_results(spark, sf_dir), "sum")


@query(_merge_sql("sum(score / (idx + 1))"))
def merge_weighted(spark, sf_dir):
    return merged(_results(spark, sf_dir), "weighted")


_SIGNALS = """hits as (select entry_id, count(*) as tags from entry_tags where tag in ('en', 'src1') group by 1),
cued as (select distinct source_id as entry_id from relations where relation_type = 'depends_on'),
terms as (select entry_id, least(1.0, len(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9à-öø-ÿ]+'), lambda t: t in ('the', 'onat'))) / 20.0)::double as fts from entries),
light as (select e.*, round(case when c.entry_id is not null then 50.0 else 0.0 end + 10.0 * coalesce(h.tags, 0)
  + case scope_type when 'session' then 20.0 when 'project' then 15.0 when 'org' then 10.0 else 5.0 end
  + 30.0 * fts + case when entry_type = 'guideline' then priority * 0.2 else 0.0 end, 6) as light_score
  from entries e join terms using (entry_id) left join hits h using (entry_id) left join cued c using (entry_id) where is_active and fts > 0)"""


def light_scores(spark, sf_dir) -> DataFrame:
    """Active entries that a full-text search finds, with the light score: relation, tags, scope, text and priority, but no recency."""
    entries, tags = views.entries(spark, sf_dir).filter("is_active"), views.entry_tags(spark, sf_dir)
    hits = tags.filter(F.col("tag").isin("en", "src1")).groupBy("entry_id").agg(F.count(F.lit(1)).alias("tags"))
    cued = views.relations(spark, sf_dir).filter("relation_type = 'depends_on'").select(F.col("source_id").alias("entry_id")).distinct().withColumn("cued", F.lit(True))
    found = F.size(F.filter(fulltext.tokens(F.col("content")), lambda t: t.isin("the", "onat")))
    rows = entries.withColumn("fts", F.least(F.lit(1.0), found / 20.0)).filter("fts > 0").drop("content")
    place = F.when(F.col("scope_type") == "session", 0).when(F.col("scope_type") == "project", 1).when(F.col("scope_type") == "org", 2).otherwise(3)
    light = (
        F.when(F.col("cued"), 50.0).otherwise(0.0)
        + F.coalesce("tags", F.lit(0)) * scoring.WEIGHTS["tag"]
        + scoring.scope_term(place, 4)
        + F.col("fts") * scoring.WEIGHTS["text"]
        + F.when(F.col("entry_type") == "guideline", F.col("priority") * (scoring.WEIGHTS["priority"] / 100)).otherwise(0.0)
    )
    return rows.join(hits, "entry_id", "left").join(cued, "entry_id", "left").withColumn("light_score", F.round(light, 6))


@query(sql(f"+{_SIGNALS} select entry_id, light_score from light order by light_score desc, entry_id limit 50", "entries", "entry_tags", "relations"))
def light_score_topk(spark, sf_dir):
    return light_scores(spark, sf_dir).select("entry_id", "light_score").orderBy(F.desc("light_score"), "entry_id").limit(50)


@query(sql(f"""+{_SIGNALS}, head as (select * from light order by light_score desc, entry_id limit {math.ceil(1.5 * LIMIT)})
select entry_id, light_score, round(light_score + exp(-ln(2.0) * (({AS_OF_HOURS} - born_h) / 24.0) / 30.0) * 10.0, 6) as score from head order by score desc, entry_id limit {LIMIT}""", "entries", "entry_tags", "relations"))
def two_phase_search(spark, sf_dir):
    """The light score picks one and a half times the limit, the full score orders those: both phases are bounded top-k."""
    head = light_scores(spark, sf_dir).orderBy(F.desc("light_score"), "entry_id").limit(math.ceil(1.5 * LIMIT))
    full = F.round(F.col("light_score") + scoring.recency((F.lit(AS_OF_HOURS) - F.col("born_h")) / 24.0), 6)
    return head.select("entry_id", "light_score", full.alias("score")).orderBy(F.desc("score"), "entry_id").limit(LIMIT)


def page_after(rows: DataFrame, keys: list[tuple[str, bool]], cursor: dict | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after ``cursor`` (a row's key values) in the order of ``keys`` (column, descending); no row is counted off."""
    order = [F.desc(c) if down else F.asc(c) for c, down in keys]
    if cursor is None:
        return rows.orderBy(*order).limit(limit)
    after, same = F.lit(False), F.lit(True)
    for c, down in keys:
        after = after | (same & (F.col(c) < cursor[c] if down else F.col(c) > cursor[c]))
        same = same & (F.col(c) == cursor[c])
    return rows.filter(after).orderBy(*order).limit(limit)


@query(sql("select entry_id, priority from entries where is_active and (priority < 90 or (priority = 90 and entry_id > 40)) order by priority desc, entry_id limit 30", "entries"))
def cursor_page(spark, sf_dir):
    """The page after a sealed cursor."""
    secret = spark.conf.get("sparkloom.cursor.secret", "") or secrets.token_urlsafe(32)
    given = cursors.sealed({"priority": 90, "entry_id": 40}, secret, 0)
    rows = views.entries(spark, sf_dir).filter("is_active").select("entry_id", "priority")
    return page_after(rows, [("priority", True), ("entry_id", False)], cursors.opened(given, secret, cursors.HOUR_MS), 30)


@query("""select event_id, urgency, severity from (select event_id, ['low', 'normal', 'high', 'critical'][(event_id % 4 + 1)::int] as urgency, ['minor', 'major', 'blocker'][(event_id // 4 % 3 + 1)::int] as severity from events where event_type = 'error')
 order by urgency desc, severity desc, event_id limit 40""")
def enum_sorted(spark, sf_dir):
    """Tasks by urgency, then severity, both descending as text: 'normal' comes before 'low' and 'high', as their names do."""
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), k.cast("int"))
    n = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        "event_id", pick(("low", "normal", "high", "critical"), n % 4).alias("urgency"), pick(("minor", "major", "blocker"), F.floor(n / 4) % 3).alias("severity")
    )
    return rows.orderBy(F.desc("urgency"), F.desc("severity"), "event_id").limit(40)


@query(sql("""+both_ways as (select source_id as origin, target_id as node, relation_type, 'out' as side from relations union all select target_id, source_id, relation_type, 'in' from relations)
select origin, node, relation_type, side from both_ways join entries on entry_id = node where origin in (7, 11, 23) and relation_type in ('depends_on', 'related_to', 'applies_to', 'parent_task') and entry_type in ('guideline', 'knowledge', 'tool')
order by origin, node, relation_type, side limit 20""", "relations", "entries"))
def neighbors_filtered(spark, sf_dir):
    """Neighbours on both sides of some nodes, by edge type and by the neighbour's own type, up to a limit."""
    types = views.entries(spark, sf_dir).select(F.col("entry_id").alias("node"), "entry_type")
    found = graph.neighbours(views.relations(spark, sf_dir), [7, 11, 23], "both", ["depends_on", "related_to", "applies_to", "parent_task"])
    typed = found.join(types.filter(F.col("entry_type").isin("guideline", "knowledge", "tool")), "node").select(F.col("at").alias("origin"), "node", "relation_type", "side")
    return typed.orderBy("origin", "node", "relation_type", "side").limit(20)


def fnv1a(text: Column) -> Column:
    """FNV-1a over a text's UTF-8 bytes, 32 bits, as a long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(0), F.greatest(F.length(digits) / 2 - 1, F.lit(0)).cast("int")), lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(1 << 32))
    return F.when(F.length(digits) > 0, F.aggregate(octets, F.lit(2166136261).cast("long"), step)).otherwise(F.lit(2166136261).cast("long"))


@query("""select event_id, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(event_type || ':' || user_id, ''), lambda c: ascii(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as cache_key from events""")
def cache_keys(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", fnv1a(F.concat_ws(":", "event_type", "user_id")).alias("cache_key"))


@query(sql("""select entry_id, entry_type from entries where len(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9à-öø-ÿ]+'), lambda t: starts_with(t, 'onat') or t = 'within')) > 0
 union all select entry_id, 'content:' || entry_type from entries where len(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9à-öø-ÿ]+'), lambda t: starts_with(t, 'onat') or t = 'within')) > 0 and entry_type = 'tool'""", "entries"))
def fts_column_match(spark, sf_dir):
    """A match in one column only, for each type: titles of all types, contents of tools."""
    wanted = fulltext.pattern_terms(["onat", "within"])
    hit = lambda c: F.exists(fulltext.tokens(F.col(c)), lambda t: fulltext.term_match(t, wanted))
    rows = views.entries(spark, sf_dir)
    titles = rows.filter(hit("title")).select("entry_id", "entry_type")
    return titles.unionByName(rows.filter("entry_type = 'tool'").filter(hit("content")).select("entry_id", F.concat(F.lit("content:"), "entry_type").alias("entry_type")))


@query(sql("""+e as (select distinct source_id as a, target_id as b from relations where relation_type = 'parent_task' and source_id <> target_id),
ends as (select a, b from e union select b, a from e),
r as (select a as node, a as other from ends union select node, b from r join ends on other = a),
c as (select node, min(other) as root from r group by node), s as (select root, count(*) as n from c group by root),
w as (select root, count(*) as edges from e join c on a = node group by root)
select root, n, edges, case when n < 10 or 0.75 >= 0.85 then 'connected' else 'leiden' end as algorithm, n >= 3 as is_community from s join w using (root)""", "relations"))
def community_choice(spark, sf_dir):
    """Each component's size, the algorithm for it (small ones and high thresholds need no modularity moves) and whether it is large enough."""
    threshold, small, least = 0.75, 10, 3
    edges = views.relations(spark, sf_dir).filter("relation_type = 'parent_task' and source_id <> target_id").select("source_id", "target_id", "relation_type").distinct()
    parts = graph.components(edges)
    sizes = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    inner = edges.join(parts, edges["source_id"] == parts["node"]).groupBy("root").agg(F.count(F.lit(1)).alias("edges"))
    chosen = F.when((F.col("n") < small) | F.lit(threshold >= 0.85), "connected").otherwise("leiden")
    return sizes.join(inner, "root").select("root", "n", "edges", chosen.alias("algorithm"), (F.col("n") >= least).alias("is_community"))


@query("""with r as (select event_id as id, user_id || ':' || event_type as state, value from events),
p as (select *, row_number() over (partition by state order by value desc, id) - 1 as down, row_number() over (partition by state order by value, id desc) - 1 as up, count(*) over (partition by state) as n from r)
select a.state, a.down::int as place, a.id as chosen, b.id as rejected, round(a.value - b.value, 6) as margin from p a join p b on a.state = b.state and a.down = b.up
 where a.n >= 4 and a.down < least(a.n - 2, 3) and a.value > b.value + 0.1""")
def dpo_mirrored(spark, sf_dir):
    """Of states with four examples or more: the best against the worst, the second against the second worst, and the third so."""
    rows = views.table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("state"), F.col("event_id").alias("id"), "value")
    top = lambda order: F.row_number().over(Window.partitionBy("state").orderBy(*order)).alias("rank")
    # three rows of each end are all that pairs are made of: map tasks keep no more of a state before the shuffle
    best = rows.select("state", "id", "value", top([F.desc("value"), "id"])).filter("rank <= 3").withColumn("place", F.col("rank") - 1)
    worst = rows.select("state", F.col("id").alias("rejected"), F.col("value").alias("low"), top(["value", F.desc("id")])).filter("rank <= 3").withColumn("place", F.col("rank") - 1).drop("rank")
    sizes = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    pairs = best.join(worst, ["state", "place"]).join(sizes, "state").filter((F.col("place") < F.least(F.col("n") - 2, F.lit(3))) & (F.col("value") > F.col("low") + 0.1))
    return pairs.select("state", "place", F.col("id").alias("chosen"), "rejected", F.round(F.col("value") - F.col("low"), 6).alias("margin"))


@query(sql("""+s as (select count(*) filter (where access_count >= 15) as high, count(*) filter (where access_count = 0 and (744 - born_h) / 24.0 > 3) as low,
 count(*) filter (where access_count >= 20 and priority < 30) as misplaced, count(*) filter (where is_active) as active, avg(abs(priority / 100.0 - access_count / 22.0))::double as adjustment, count(distinct entry_type) as buckets,
 count(*) filter (where entry_id % 100 = 3) as adjusted from entries)
select 'extraction_threshold' as target, 'policy_weight' as kind, 0.5 as before_value, 0.6 as suggested, round(least(low / 20.0, 0.8), 6)::double as confidence from s where low > high * 2
union all select 'duplicate_similarity_threshold', 'threshold', 0.85, 0.88, 0.7::double from s where adjusted > 0
union all select 'auto_categorization', 'category_mapping', 1.0, 0.0, round(least(misplaced / active, 0.9), 6)::double from s where misplaced / active > 0.2
union all select 'confidence_weight', 'policy_weight', 1.0, round(1.0 - adjustment, 6), round(least(buckets / 5.0, 0.8), 6)::double from s where adjustment > 0.15""", "entries").replace("0.5 as before_value, 0.6 as suggested", "0.5::double as before_value, 0.6::double as suggested"))
def feedback_decisions(spark, sf_dir):
    """What the accuracy signals of the upkeep jobs suggest: thresholds and weights with the confidence of each."""
    n = lambda when: F.count(F.when(F.expr(when), 1))
    signals = views.entries(spark, sf_dir).agg(
        n("access_count >= 15").alias("high"), n("access_count = 0 and (744 - born_h) / 24.0 > 3").alias("low"), n("access_count >= 20 and priority < 30").alias("misplaced"),
        n("is_active").alias("active"), F.avg(F.abs(F.col("priority") / 100.0 - F.col("access_count") / 22.0)).alias("adjustment"),
        F.countDistinct("entry_type").alias("buckets"), n("entry_id % 100 = 3").alias("adjusted"),
    )
    share = F.try_divide("misplaced", "active")

    def decision(when: Column, target: str, kind: str, before: float, suggested: Column | float, confidence: Column | float) -> Column:
        value = lambda x: (F.lit(x) if isinstance(x, float) else F.round(x, 6)).cast("double")
        return F.when(when, F.struct(F.lit(target).alias("target"), F.lit(kind).alias("kind"), F.lit(before).alias("before_value"), value(suggested).alias("suggested"), value(confidence).alias("confidence")))

    decisions = F.array(
        decision(F.col("low") > F.col("high") * 2, "extraction_threshold", "policy_weight", 0.5, 0.6, F.least(F.col("low") / 20.0, F.lit(0.8))),
        decision(F.col("adjusted") > 0, "duplicate_similarity_threshold", "threshold", 0.85, 0.88, 0.7),
        decision(share > 0.2, "auto_categorization", "category_mapping", 1.0, 0.0, F.least(share, F.lit(0.9))),
        decision(F.col("adjustment") > 0.15, "confidence_weight", "policy_weight", 1.0, 1.0 - F.col("adjustment"), F.least(F.col("buckets") / 5.0, F.lit(0.8))),
    )
    return signals.select(F.explode(F.array_compact(decisions)).alias("d")).select("d.*")


_SAID = f"""said as (select event_id, user_id, trim(text) as t from messages), first as (select event_id, user_id, t, {commands.sql_first('t', commands.COMMANDS)} as f, regexp_matches(t, '{commands.QUESTION}') as asks,
 list_sort([{', '.join(f"{{'hits': {commands.sql_hits('t', p)}, 'k': {-k}, 'name': '{n}'}}" for k, (n, p) in enumerate(commands.ENTRY_TYPES.items()))}], 'desc')[1] as kind from said)"""


@query(sql(f"""+{_SAID} select event_id, user_id, case when f is not null then f.name when asks then 'retrieve' when kind.hits > 0 then 'store' else 'unknown' end as command, coalesce(f.hits, 0)::int as hits,
 case when f is not null then least(1.0, round(0.6 + f.hits * 0.15, 6)) when asks or kind.hits > 0 then 0.5 else 0.0 end::double as confidence, case when f is null and not asks and kind.hits > 0 then kind.name end as entry_type from first""", "messages"))
def command_intent(spark, sf_dir):
    """The command that each message gives, or the type of entry that it speaks of."""
    said = views.messages(spark, sf_dir).select("event_id", "user_id", commands.command(F.col("text")).alias("c"))
    return said.select("event_id", "user_id", F.col("c.intent").alias("command"), F.col("c.hits").alias("hits"), F.col("c.confidence").alias("confidence"), F.col("c.entry_type").alias("entry_type"))


@query(sql(f"""+w as (select event_id, trim(text) as t from messages), f as (select event_id, t, {commands.sql_first('t', commands.WORK)} as f, {commands.sql_hits('t', commands.NO_WORK)} > 0 as out, len(regexp_split_to_array(t, '\\s+')) >= 3 as several from w)
select event_id, not out and (f is not null or several) as begins, case when not out then f.name end as work, case when out then 0.0 when f is not null then least(0.95, round(0.6 + f.hits * 0.1, 6)) when several then 0.5 else 0.0 end::double as confidence from f""", "messages"))
def announced_work(spark, sf_dir):
    """Whether an episode begins with what was said, and of which kind."""
    judged = lambda texts: texts.withColumn("w", commands.announced_work(F.col("text")))
    return signals.once_each(views.messages(spark, sf_dir), ["text"], judged).select("event_id", "w.*")
