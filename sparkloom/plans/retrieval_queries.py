"""Queries of scans, scopes, predicates, projections and the search plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import filters, policies, scope
from ..registry import query
from ..sources import views
from ..sources.views import AS_OF_HOURS, sql
from .search import SearchPlan, search


def session_chain(spark, sf_dir, session: int = 1):
    sessions, projects = views.scopes(spark, sf_dir)
    return scope.scope_chains(sessions.filter(F.col("session_id") == session), projects)


_CHAIN = """chain as (
 select * from (values (0, 'session', 1::bigint)) v(place, scope_type, scope_id)
 union all select 1, 'project', c_nationkey from customer where c_custkey = 1
 union all select 2, 'org', n_regionkey from customer join nation on n_nationkey = c_nationkey where c_custkey = 1
 union all select 3, 'global', null)"""
_SCOPED = f"{_CHAIN}, scoped as (select e.*, place from entries e join chain c on e.scope_type = c.scope_type and e.scope_id is not distinct from c.scope_id where is_active)"


@query(sql(f"""+{_SCOPED},
scored as (select s.*, round(10.0 + 20.0 * (4 - place) / 4.0 + 30.0 + case when entry_type = 'guideline' then priority * 0.2 else 0.0 end
  + exp(-ln(2.0) * ((744 - born_h) / 24.0) / 30.0) * 10.0, 6) as score
  from scoped s where lower(title) like '%the%' and entry_id in (select entry_id from entry_tags where lower(tag) = 'en'))
select entry_id, entry_type, scope_type, score from scored order by score desc, born_h desc, entry_id limit 20""", "entries", "entry_tags"))
def search_scoped_text(spark, sf_dir):
    plan = SearchPlan(search="the", tags_include=("en",))
    found = search(plan, views.entries(spark, sf_dir), views.entry_tags(spark, sf_dir), session_chain(spark, sf_dir), 4, AS_OF_HOURS)
    return found.select("entry_id", "entry_type", "scope_type", "score")


@query(sql(f"""+{_SCOPED},
scored as (select s.*, round(20.0 * (4 - place) / 4.0 + case when entry_type = 'guideline' then priority * 0.2 else 0.0 end
  + greatest(0.0, 1 - ((744 - born_h) / 24.0) / 20.0) * 30.0, 6) as score
  from scoped s where entry_type in ('guideline', 'knowledge') and born_h between 100 and 600 and (entry_type <> 'guideline' or priority between 20 and 90)
  and entry_id not in (select entry_id from entry_tags where lower(tag) = 'src0'))
select entry_id, entry_type, scope_type, score from scored order by score desc, born_h desc, entry_id limit 30 offset 5""", "entries", "entry_tags"))
def search_dated_page(spark, sf_dir):
    plan = SearchPlan(types=("guideline", "knowledge"), tags_exclude=("SRC0",), born_after_h=100, born_before_h=600, priority=(20, 90), recency_weight=0.3, half_life_days=10, decay="linear", limit=30, offset=5)
    found = search(plan, views.entries(spark, sf_dir), views.entry_tags(spark, sf_dir), session_chain(spark, sf_dir), 4, AS_OF_HOURS)
    return found.select("entry_id", "entry_type", "scope_type", "score")


@query("""select session_id, place, scope_type, scope_id from (
 select c_custkey as session_id, 0 as place, 'session' as scope_type, c_custkey as scope_id from customer
 union all select c_custkey, 1, 'project', c_nationkey from customer
 union all select c_custkey, 2, 'org', n_regionkey from customer left join nation on n_nationkey = c_nationkey
 union all select c_custkey, 3, 'global', null from customer)""")
def scope_chain(spark, sf_dir):
    return scope.scope_chains(*views.scopes(spark, sf_dir))


@query(sql(f"+{_SCOPED} select entry_type, scope_type, count(*) as n from scoped group by all", "entries"))
def scope_totals(spark, sf_dir):
    found = scope.in_scope(views.entries(spark, sf_dir).filter("is_active"), session_chain(spark, sf_dir))
    return found.groupBy("entry_type", "scope_type").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"+{_SCOPED} select entry_id, category, entry_type, place from scoped qualify row_number() over (partition by category, entry_type order by place, entry_id) = 1", "entries"))
def scope_nearest_per_key(spark, sf_dir):
    found = scope.in_scope(views.entries(spark, sf_dir).filter("is_active"), session_chain(spark, sf_dir))
    return scope.nearest_per_key(found, "category", "entry_type").select("entry_id", "category", "entry_type", "place")


@query(sql("select entry_id, entry_type, priority from entries where scope_type in ('global', 'org')", "entries"))
def permission_filter(spark, sf_dir):
    grants = spark.createDataFrame([("global", "admin"), ("org", "write"), ("project", "read")], "scope_type string, level string")
    return scope.permitted(views.entries(spark, sf_dir), grants, "write").select("entry_id", "entry_type", "priority")


@query(sql(f"+{_CHAIN} select e.entry_id, e.priority, place from entries e join chain c on e.scope_type = c.scope_type and e.scope_id is not distinct from c.scope_id where is_active and entry_type = 'guideline' and priority >= 90", "entries"))
def critical_in_scope(spark, sf_dir):
    critical = views.entries(spark, sf_dir).filter("is_active and entry_type = 'guideline' and priority >= 90")
    return scope.in_scope(critical, session_chain(spark, sf_dir)).select("entry_id", "priority", "place")


@query(sql("select entry_id, (select count(*) from entry_tags t where t.entry_id = e.entry_id and tag in ('en', 'de'))::int as include_hits from entries e where exists (select 1 from entry_tags t where t.entry_id = e.entry_id and tag in ('en', 'de'))", "entries", "entry_tags"))
def filter_tags_include(spark, sf_dir):
    return filters.tags_filter(views.entries(spark, sf_dir), views.entry_tags(spark, sf_dir), include=("EN", "de")).select("entry_id", "include_hits")


@query(sql("select entry_id from entries e where lang = 'en' and category = 'src3'", "entries"))
def filter_tags_require(spark, sf_dir):
    return filters.tags_filter(views.entries(spark, sf_dir), views.entry_tags(spark, sf_dir), require=("en", "SRC3")).select("entry_id")


@query(sql("select entry_id from entries e where coalesce(lang, '') <> 'en' and coalesce(category, '') <> 'src3'", "entries"))
def filter_tags_exclude(spark, sf_dir):
    return filters.tags_filter(views.entries(spark, sf_dir), views.entry_tags(spark, sf_dir), exclude=("en", "src3")).select("entry_id")


@query(sql("select entry_id, born_h from entries where born_h between 48 and 240", "entries"))
def date_range(spark, sf_dir):
    return views.entries(spark, sf_dir).filter(filters.in_range(F.col("born_h"), 48, 240)).select("entry_id", "born_h")


@query(sql("select entry_id, priority from entries where entry_type = 'guideline' and priority between 25 and 75", "entries"))
def priority_range(spark, sf_dir):
    return views.entries(spark, sf_dir).filter(F.col("entry_type") == "guideline").filter(filters.in_range(F.col("priority"), 25, 75)).select("entry_id", "priority")


@query(sql("select entry_id, title from entries join validity using (entry_id) where (from_h is null or from_h <= 360) and (until_h is null or until_h > 360)", "entries", "validity"))
def temporal_at_time(spark, sf_dir):
    rows = views.entries(spark, sf_dir).join(views.validity(spark, sf_dir), "entry_id")
    return rows.filter(filters.valid_at(360, F.col("from_h"), F.col("until_h"))).select("entry_id", "title")


@query(sql("select entry_id, title from entries join validity using (entry_id) where (from_h is null or from_h <= 400) and (until_h is null or until_h >= 200)", "entries", "validity"))
def temporal_valid_during(spark, sf_dir):
    rows = views.entries(spark, sf_dir).join(views.validity(spark, sf_dir), "entry_id")
    return rows.filter(filters.valid_during(200, 400, F.col("from_h"), F.col("until_h"))).select("entry_id", "title")


@query(sql("select entry_id, title from entries where lower(title) like '%ing%' and not regexp_matches(title, '(?i)\\bthe\\b') and not lower(title) like '%of a%'", "entries"))
def filter_exclusions(spark, sf_dir):
    rest, words, phrases = text.parse_exclusions('ing -the -"of a"')
    rows = views.entries(spark, sf_dir).filter(text.contains(F.col("title"), rest))
    return rows.filter(~text.excluded(F.col("title"), words, phrases)).select("entry_id", "title")


@query("select p_partkey, p_name from part where lower(p_name) like '%red widgte%' or levenshtein(lower(p_name), 'red widgte') <= floor(greatest(length(p_name), 10) * 0.3)")
def filter_fuzzy(spark, sf_dir):
    return views.table(spark, sf_dir, "part").filter(text.fuzzy(F.col("p_name"), "red widgte")).select("p_partkey", "p_name")


@query("""select p_partkey, p_name from part where len(list_filter(string_split(lower(p_name), ' '), lambda w: levenshtein(w, 'rd') <= 1)) > 0
 and len(list_filter(string_split(lower(p_name), ' '), lambda w: levenshtein(w, 'widgt') <= 1)) > 0""")
def filter_fuzzy_terms(spark, sf_dir):
    return views.table(spark, sf_dir, "part").filter(text.fuzzy_terms(F.col("p_name"), "rd widgt")).select("p_partkey", "p_name")


@query(sql("select entry_id, title from entries where regexp_matches(substr(title, 1, 10000), '(?i)^th[aeiou]+.*ing')", "entries"))
def filter_regex(spark, sf_dir):
    return views.entries(spark, sf_dir).filter(text.regex(F.col("title"), "^th[aeiou]+.*ing")).select("entry_id", "title")


@query(sql("select entry_id from entries where contains(lower(content), '100%_of') or contains(lower(content), '%%% of')", "entries"))
def filter_like(spark, sf_dir):
    """The plain-text fallback: wildcard characters are ordinary text."""
    content = F.col("content")
    return views.entries(spark, sf_dir).filter(text.contains(content, "100%_of") | text.contains(content, "%%% of")).select("entry_id")


@query(sql("select entry_id, title as name, category, case when entry_type = 'guideline' then priority end as priority, case when entry_type = 'experience' then 'case' end as level from entries", "entries"))
def compact_projection(spark, sf_dir):
    kind = F.col("entry_type")
    return views.entries(spark, sf_dir).select(
        "entry_id", F.col("title").alias("name"), "category", F.when(kind == "guideline", F.col("priority")).alias("priority"), F.when(kind == "experience", "case").alias("level")
    )


@query(sql("select entry_id, v.version_num, v.note, length(concat_ws(' ', title, category))::bigint as searchable from entries join (select * from versions qualify row_number() over (partition by entry_id order by version_num desc) = 1) v using (entry_id)", "entries", "versions"))
def versions_current(spark, sf_dir):
    rows = views.entries(spark, sf_dir).join(filters.current_version(views.versions(spark, sf_dir)), "entry_id")
    return rows.select("entry_id", "version_num", "note", F.length(F.concat_ws(" ", "title", "category")).cast("long").alias("searchable"))


@query(sql("select entry_id, string_agg(note, '>' order by version_num desc) as history, count(*) as n from versions group by entry_id", "versions"))
def version_history(spark, sf_dir):
    rows = views.versions(spark, sf_dir).groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("version_num", "note")), asc=False).alias("h"))
    return rows.select("entry_id", F.array_join(F.col("h.note"), ">").alias("history"), F.size("h").cast("long").alias("n"))


@query(sql("select entry_id, version_num, version_s - before as gap_s from (select *, lag(version_s) over (partition by entry_id order by version_num) as before from versions) where version_s - before < 5", "versions"))
def version_conflicts(spark, sf_dir):
    """Versions written less than five seconds after the one before."""
    v = views.versions(spark, sf_dir)
    before = v.select("entry_id", (F.col("version_num") + 1).alias("version_num"), F.col("version_s").alias("before"))
    gap = F.col("version_s") - F.col("before")
    return v.join(before, ["entry_id", "version_num"]).filter(gap < 5).select("entry_id", "version_num", gap.alias("gap_s"))


@query(sql("""select entry_id, round(exp(-ln(2.0) * age / 30), 6) as exponential, round(greatest(0.0, 1 - age / 60), 6) as linear, case when age <= 30 then 1.0::double else 0.5::double end as step, case when age <= 30 then 1.0::double else 0.0::double end as strict_step
 from (select entry_id, (744 - born_h) / 24.0 as age from entries)""", "entries"))
def decay_curves(spark, sf_dir):
    age = (F.lit(AS_OF_HOURS) - F.col("born_h")) / 24.0
    return views.entries(spark, sf_dir).select(
        "entry_id", F.round(scoring.decay(age), 6).alias("exponential"), F.round(scoring.decay(age, kind="linear"), 6).alias("linear"),
        scoring.decay(age, kind="step").alias("step"), scoring.decay(age, kind="step", late_step=0.0).alias("strict_step"),
    )


_AGES = "(select *, (744 - born_h) / 24.0 as age, greatest(0.0, (744 - born_h - access_lag_h) / 24.0) as idle from entries)"


@query(sql(f"select entry_id, reason from (select entry_id, case when age > 20 then 'old_age' when exp(-ln(2.0) * age / 5) < 0.2 then 'low_recency' when idle > 3 then 'not_accessed' end as reason from {_AGES}) where reason is not null", "entries"))
def staleness(spark, sf_dir):
    age, idle = (F.lit(AS_OF_HOURS) - F.col("born_h")) / 24.0, F.greatest(F.lit(0.0), (F.lit(AS_OF_HOURS) - F.col("born_h") - F.col("access_lag_h")) / 24.0)
    idle = F.when(F.col("access_lag_h").isNotNull(), idle)
    reason = scoring.staleness(age, idle, stale_age=20, unused=3, half_life=5)
    return views.entries(spark, sf_dir).select("entry_id", reason.alias("reason")).filter("reason is not null")


@query(sql(f"""select entry_id, recency, frequency, importance, round(0.35 * recency + 0.35 * frequency + 0.3 * importance, 9) as combined,
 priority >= 90 as protected, round(0.35 * recency + 0.35 * frequency + 0.3 * importance, 9) < 0.4 and priority < 90 as forget from (
 select entry_id, priority, round(greatest(0.0, 1 - coalesce(idle, age) / 90), 3) as recency, round(least(1.0, ln(access_count + 1) / ln(21.0)), 6) as frequency, priority / 100.0 as importance from
 (select *, (744 - born_h) / 24.0 as age, case when access_lag_h is not null then greatest(0.0, (744 - born_h - access_lag_h) / 24.0) end as idle from entries))""", "entries"))
def forgetting(spark, sf_dir):
    age = (F.lit(AS_OF_HOURS) - F.col("born_h")) / 24.0
    idle = F.when(F.col("access_lag_h").isNotNull(), F.greatest(F.lit(0.0), age - F.col("access_lag_h") / 24.0))
    rows = views.entries(spark, sf_dir).select(
        "entry_id", "priority", scoring.forget_recency(F.coalesce(idle, age)).alias("recency"),
        F.round(scoring.forget_frequency(F.col("access_count")), 6).alias("frequency"), (F.col("priority") / 100.0).alias("importance"),
    )
    combined = F.round(0.35 * F.col("recency") + 0.35 * F.col("frequency") + 0.3 * F.col("importance"), 9)
    return rows.select("entry_id", "recency", "frequency", "importance", combined.alias("combined"), (F.col("priority") >= 90).alias("protected"), ((combined < 0.4) & (F.col("priority") < 90)).alias("forget"))


@query(sql("select entry_id, (744 - born_h) / 24.0 as age_days from entries where is_active and (744 - born_h) / 24.0 >= 14 and exp(-ln(2.0) * ((744 - born_h) / 24.0) / 14) < 0.4", "entries"))
def archive_stale(spark, sf_dir):
    age = (F.lit(AS_OF_HOURS) - F.col("born_h")) / 24.0
    return views.entries(spark, sf_dir).filter(F.col("is_active") & (age >= 14) & (scoring.decay(age, 14) < 0.4)).select("entry_id", age.alias("age_days"))


@query(sql("""select entry_id, entry_type, place, running from (
 select *, sum(tokens) over (partition by entry_type order by priority desc, entry_id rows unbounded preceding)::bigint as running, row_number() over (partition by entry_type order by priority desc, entry_id)::int as place
 from (select *, ceil(length(content) * 0.25)::bigint as tokens from entries where is_active)) where running <= 4000""", "entries"))
def token_budget(spark, sf_dir):
    """Entries of each type, by priority, while their token estimates fit the type's budget."""
    rows = views.entries(spark, sf_dir).filter("is_active").select("entry_id", "entry_type", "priority", scoring.token_estimate(F.col("content")).alias("tokens"))
    return policies.within_budget(rows, 4000).select("entry_id", "entry_type", "place", "running")


@query(sql("""select entry_id, entry_type, place from (select entry_id, entry_type, row_number() over (partition by entry_type order by priority desc, entry_id)::int as place from entries where is_active)
 join (values ('tool', 4), ('guideline', 8), ('knowledge', 6), ('experience', 2)) q(entry_type, quota) using (entry_type) where place <= quota""", "entries"))
def quota_topn(spark, sf_dir):
    """Type quotas: shares 2:4:3:1 of twenty places; the largest quota bounds what map tasks keep of a type."""
    from pyspark.sql import Window

    shares = {"tool": 2, "guideline": 4, "knowledge": 3, "experience": 1}
    quota = {t: max(1, int(w / sum(shares.values()) * 20 + 0.5)) for t, w in shares.items()}
    limit = F.coalesce(*[F.when(F.col("entry_type") == t, q) for t, q in quota.items()])
    w = Window.partitionBy("entry_type").orderBy(F.desc("priority"), "entry_id")
    return views.entries(spark, sf_dir).filter("is_active").withColumn("place", F.row_number().over(w)).filter((F.col("place") <= max(quota.values())) & (F.col("place") <= limit)).select("entry_id", "entry_type", "place")
