"""Queries of tags, compound entries, policy states and datasets, merged entries, levels of summaries, and small helpers of the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import maintenance, sequence, signals, states, tagging, vector
from ..registry import query
from ..sources import exchange, views
from ..sources.views import sql
from .signal_queries import _TOLD, _TOLD_SQL, _lit, _named_sql
from .vector_queries import _COS, _query_vector

_CATEGORY = {"guideline": "code_style", "knowledge": "fact", "tool": "api"}
_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in _CATEGORY.items())


def _paired(spark, sf_dir) -> DataFrame:
    """(event_id, entry_type, text): messages, each followed by one more sentence."""
    n = len(views.SENTENCES)
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    more = pick(views.SENTENCES, F.floor(F.col("event_id") / n) % n)
    return views.messages(spark, sf_dir).select("event_id", pick(views.TYPES, F.col("event_id") % 4).alias("entry_type"), F.concat("text", F.lit(". "), more).alias("text"))


_SAID = f"[{', '.join(map(_lit, views.SENTENCES))}][(event_id // {len(views.SENTENCES)} % {len(views.SENTENCES)} + 1)::int]"
_PAIRED = f"paired as (select event_id, ['tool','guideline','knowledge','experience'][(event_id % 4 + 1)::int] as entry_type, text || '. ' || {_SAID} as text from messages)"


def _compound_sql() -> str:
    cases = " ".join(f"when regexp_matches(text, {_lit(p)}) then '{name}'" for name, p in tagging.COMPOUND)
    return f"""+{_PAIRED}, c as (select event_id, text, entry_type, len(regexp_extract_all(lower(text), {_lit(tagging.IMPERATIVES)})) as orders from paired),
r as (select event_id, entry_type, case {cases} when entry_type = 'guideline' and orders > 2 then 'many imperatives' when length(text) > {tagging.LONG_ENTRY} and len(regexp_extract_all(text, '[.!?]+')) >= 3 and orders >= 2 then 'long with imperatives' end as reason from c)
select * from r where reason is not null"""


@query(sql(_compound_sql(), "messages"))
def compound_entries(spark, sf_dir):
    """Messages that hold several statements, and why."""
    found = _paired(spark, sf_dir).select("event_id", "entry_type", tagging.compound(F.col("text"), F.col("entry_type")).alias("reason"))
    return found.filter("reason is not null")


def _tags_sql() -> str:
    word = lambda k: f"case when contains(low, {_lit(k)}) then {2 if ' ' in k else 1} else 0 end"
    tags = ", ".join(f"{{'place': {n}, 'tag': '{tag}', 'c': least(1.0, ({' + '.join(map(word, keys))}) / {max(3.0, 0.3 * len(keys))}::double)}}" for n, (tag, keys) in enumerate(tagging.TAG_KEYWORDS.items()))
    given = ", ".join(f"('{c}', {len(tagging.TAG_KEYWORDS) + n}, '{t}')" for n, (c, t) in enumerate((c, t) for c, names in tagging.CATEGORY_TAGS.items() for t in names))
    return f"""+e as (select entry_id, lower(coalesce(content, '')) as low, case entry_type {_CASES} end as category from entries),
w as (select entry_id, t.place as place, t.tag as tag, t.c as c from (select entry_id, unnest([{tags}]) as t from e) where t.c >= {tagging.LEAST_CONFIDENCE}),
g as (select entry_id, place, tag, {tagging.CATEGORY_CONFIDENCE}::double as c from e join (values {given}) k(category, place, tag) using (category) where not exists (select 1 from w where w.entry_id = e.entry_id and w.tag = k.tag)),
a as (select *, 'keyword' as source from w union all select *, 'category' from g), r as (select *, row_number() over (partition by entry_id order by c desc, place) as n from a)
select entry_id, tag, round(c, 6) as confidence, source from r where n <= {tagging.MOST_TAGS}"""


@query(sql(_tags_sql(), "entries"))
def keyword_tags(spark, sf_dir):
    """The three surest tags of each entry, by keywords in its whole text and by its category."""
    category = F.coalesce(*[F.when(F.col("entry_type") == k, v) for k, v in _CATEGORY.items()])
    rows = views.entries(spark, sf_dir).select(F.col("entry_id").alias("id"), "content", category.alias("category"))
    return tagging.tags(rows).withColumnRenamed("id", "entry_id")


def _features_sql(said: str) -> str:
    kinds = " ".join(f"when regexp_matches(lower({said}), {_lit(p)}) then '{k}'" for k, p in states.QUERY_KINDS)
    return f"""length({said})::int as query_length, {said} <> '' as has_keywords,
 round(least(1.0::double, case when {said} = '' then 0 else len(string_split_regex({said}, '\\s+')) end / 20.0::double + case when regexp_matches({said}, '[&|"()]') then 0.3::double else 0.0 end), 6) as query_complexity,
 case {kinds} else 'general' end as query_kind"""


@query(sql(f"select event_id, {_features_sql('text')} from messages", "messages"))
def query_features(spark, sf_dir):
    found = states.query_features(F.col("text"))
    return views.messages(spark, sf_dir).select("event_id", *[c.alias(name) for name, c in found.items()])


_WORTH = "avg(case outcome when 'success' then 1.0 when 'partial' then 0.5 else -1.0 end)::double"


def _worth():
    return F.avg(F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "partial", 0.5).otherwise(-1.0))


@query(sql(f"""+s as (select retrieval_id as id, text as said, l.entry_type, retrieval_id % 10 + 1 as rank, c from (select retrieval_id, entry_type, {_WORTH} as c from links group by all) l join messages on event_id = retrieval_id)
select id, {_features_sql('said')}, rank as turn_number, least(5, rank) as recent_calls, c < 0 as has_errors, rank * 10 as total_entries, round(greatest(0.0, least(1.0, c / 2 + 0.5)), 6)::double as success,
 entry_type as action_type, round(c, 6) as reward, ('0x' || substr(sha256(id::varchar), 1, 2))::int < 52 as is_eval from s""", "feedback", "messages"))
def retrieval_dataset(spark, sf_dir):
    """Training examples of the retrieval policy: what was asked, what was at hand, and how the outcomes that followed went."""
    links = views.feedback(spark, sf_dir)[2].groupBy("retrieval_id", "entry_type").agg(_worth().alias("contribution"))
    said = views.messages(spark, sf_dir).select(F.col("event_id").alias("retrieval_id"), F.col("text").alias("query"))
    samples = links.join(said, "retrieval_id").select(F.col("retrieval_id").alias("id"), "query", "entry_type", (F.col("retrieval_id") % 10 + 1).alias("rank"), "contribution")
    return states.retrieval_examples(samples).withColumn("is_eval", states.is_eval(F.col("id")))


_EXTRACTED = """x as (select entry_id as id, entry_id % 12 as t, priority / 101.0::double as sure, access_count as uses, entry_type as kind, case when is_active then 'store' else 'skip' end as decision,
 case when access_lag_h is not null then (access_count - 11) / 11.0::double end as outcome from entries),
d as (select id, t as turn_number, t * 500 as token_count, t * 2 as tool_calls, outcome < 0 as has_error, ceil(t / 2)::bigint as user_turns, t // 2 as assistant_turns, uses * 10 as total_entries, sure < 0.5 as similar_exists,
 greatest(1, uses) as captures, kind = 'knowledge' as has_decision, kind = 'guideline' as has_rule, kind = 'tool' as has_command, round(sure, 6) as novelty, case when kind = 'tool' then 0.7 else 0.5 end::double as complexity, decision, round(outcome, 6) as reward from x where outcome is not null)"""


def _extraction(spark, sf_dir) -> DataFrame:
    """What was extracted, how sure that was, how often it was retrieved since, and whether that did any good."""
    samples = views.entries(spark, sf_dir).select(
        F.col("entry_id").alias("id"), (F.col("entry_id") % 12).alias("turn"), (F.col("priority") / 101.0).alias("confidence"), F.col("access_count").alias("retrievals"), "entry_type",
        F.when(F.col("is_active"), "store").otherwise("skip").alias("decision"), F.when(F.col("access_lag_h").isNotNull(), (F.col("access_count") - 11) / 11.0).alias("outcome"),
    )
    return states.extraction_examples(samples)


@query(sql(f"+{_EXTRACTED} select *, ('0x' || substr(sha256(id::varchar), 1, 2))::int < 52 as is_eval from d", "entries"))
def extraction_dataset(spark, sf_dir):
    return _extraction(spark, sf_dir).withColumn("is_eval", states.is_eval(F.col("id")))


@query(sql(f"""+{_EXTRACTED} select id, case when ('0x' || substr(sha256(id::varchar), 1, 2))::int < 52 then 'test' else 'train' end as split,
 to_json({{'state': {{'turn_number': turn_number, 'token_count': token_count, 'novelty': novelty, 'complexity': complexity}}, 'action': decision, 'reward': reward}})::varchar as line from d""", "entries"))
def export_huggingface(spark, sf_dir):
    """Examples as lines of a train and a test split."""
    state = F.struct("turn_number", "token_count", "novelty", "complexity")
    rows = _extraction(spark, sf_dir).select("id", states.is_eval(F.col("id")).alias("is_eval"), state.alias("state"), F.col("decision").alias("action"), "reward")
    return exchange.split_lines(rows)


@query(sql(f"""+n as (select entry_id, count(*) as n from retrievals group by 1), f as (select entry_id, {_WORTH} as f from links group by 1),
p as (select entry_type, coalesce(n, 0) as n, coalesce(f, 0.0) as f, (744 - born_h) / 24.0 as days from entries left join n using (entry_id) left join f using (entry_id)),
k as (select case when n >= 3 and f >= 0 then 'high_value' when n = 0 and days > 14 then 'low_value' end as pattern, entry_type, n, f from p),
t as (select pattern, entry_type, count(*) as members from k where pattern is not null group by all), d as (select pattern, entry_type from (select *, row_number() over (partition by pattern order by members desc, entry_type) as place from t) where place = 1)
select pattern, d.entry_type, count(*) as members, round(avg(n), 6) as retrievals, round(avg(f), 6) as feedback, round(least(1.0, count(*) / 10.0), 6)::double as confidence from k join d using (pattern) group by pattern, d.entry_type having count(*) >= 3""", "entries", "feedback"))
def value_patterns(spark, sf_dir):
    """What entries of high and of low value have in common: their prevailing type, retrievals and feedback, from the retrievals and outcomes themselves."""
    retrievals, _, links = views.feedback(spark, sf_dir)
    used = retrievals.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).join(links.groupBy("entry_id").agg(_worth().alias("f")), "entry_id", "left")
    days = (F.lit(views.AS_OF_HOURS) - F.col("born_h")) / 24.0
    rows = views.entries(spark, sf_dir).join(used, "entry_id", "left").select("entry_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", F.lit(0.0)).alias("f"), days.alias("days"))
    marked = rows.withColumn("pattern", F.when((F.col("n") >= 3) & (F.col("f") >= 0), "high_value").when((F.col("n") == 0) & (F.col("days") > 14), "low_value")).filter("pattern is not null")
    by_type = marked.groupBy("pattern", "entry_type").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"), F.sum("f").alias("f"))
    # the most members first, then the first type by name
    prevailing = F.min(F.struct((-F.col("members")).alias("order"), "entry_type"))["entry_type"].alias("entry_type")
    found = by_type.groupBy("pattern").agg(prevailing, F.sum("members").alias("members"), F.sum("n").alias("n"), F.sum("f").alias("f")).filter("members >= 3")
    mean = lambda c: F.round(F.col(c) / F.col("members"), 6)
    return found.select("pattern", "entry_type", "members", mean("n").alias("retrievals"), mean("f").alias("feedback"), F.round(F.least(F.lit(1.0), F.col("members") / 10.0), 6).alias("confidence"))


_KINDS = ("FILE_PATH", "FUNCTION_NAME", "PACKAGE_NAME", "URL", "ERROR_CODE", "COMMAND", "CUSTOM")


@query(f"""with {_TOLD_SQL}, found as ({_named_sql()}), k as (select kind, ['tool','guideline','knowledge','experience'][(event_id % 4 + 1)::int] as entry_type from found)
select 'entity' as axis, a.name, count(k.kind) as n from (select unnest([{', '.join(map(_lit, _KINDS))}]) as name) a left join k on k.kind = a.name group by 2
union all select 'entry', a.name, count(k.kind) from (select unnest(['tool', 'guideline', 'knowledge', 'experience']) as name) a left join k on k.entry_type = a.name group by 2""")
def entity_stats(spark, sf_dir):
    """Named things by their kind and by the type of the entry they are in, with zeros where there are none."""
    said = F.element_at(F.array(*[F.lit(t) for t in _TOLD]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = views.table(spark, sf_dir, "events").select("event_id", F.concat(said, F.lit(" "), F.col("event_type")).alias("text"))
    kind = F.element_at(F.array(*[F.lit(t) for t in views.TYPES]), (F.col("event_id") % 4 + 1).cast("int"))
    counts = signals.named_things(rows).groupBy("kind", kind.alias("entry_type")).agg(F.count(F.lit(1)).alias("n"))
    names = [("entity", k) for k in _KINDS] + [("entry", t) for t in views.TYPES]
    axes = counts.select(F.explode(F.array(F.struct(F.lit("entity").alias("axis"), F.col("kind").alias("name")), F.struct(F.lit("entry").alias("axis"), F.col("entry_type").alias("name")))).alias("a"), "n")
    every = spark.createDataFrame(names, "axis string, name string")
    found = axes.groupBy("a.axis", "a.name").agg(F.sum("n").alias("n"))
    return every.join(found, ["axis", "name"], "left").select("axis", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql("select entry_id, entry_type, coalesce(note, title, '') as hydrated from entries left join (select entry_id, note from versions where version_num = 3) v using (entry_id) where is_active", "entries", "versions"))
def hydrated_entries(spark, sf_dir):
    """Heads with the text of their third version, or their title where there is none."""
    third = views.versions(spark, sf_dir).filter("version_num = 3").select("entry_id", "note")
    rows = views.entries(spark, sf_dir).filter("is_active").join(third, "entry_id", "left")
    return rows.select("entry_id", "entry_type", F.coalesce("note", "title", F.lit("")).alias("hydrated"))


@query(sql("select distinct a.entry_id, b.entry_id as promoted_to, b.entry_type as promoted_type, b.title from entries a join relations on source_id = a.entry_id and relation_type = 'promoted_to' join entries b on b.entry_id = target_id where a.entry_type = 'experience'", "entries", "relations"))
def promoted_experiences(spark, sf_dir):
    """Experiences with what they were promoted to."""
    rows = views.entries(spark, sf_dir).select("entry_id", "entry_type", "title")
    links = views.relations(spark, sf_dir).filter("relation_type = 'promoted_to'").select(F.col("source_id").alias("entry_id"), F.col("target_id").alias("promoted_to"))
    target = rows.select(F.col("entry_id").alias("promoted_to"), F.col("entry_type").alias("promoted_type"), "title")
    return rows.filter("entry_type = 'experience'").select("entry_id").join(links, "entry_id").join(target, "promoted_to").select("entry_id", "promoted_to", "promoted_type", "title").distinct()


@query(sql(f"""+one as (select v as q from vectors where vec_id = 0), s as (select entry_id, access_count / 22.0::double as smart, greatest(0.0, {_COS}) as relevance, priority / 10.0 as p from vectors join entries on entry_id = vec_id, one),
c as (select entry_id, round(least(1.0, (0.6 * smart + 0.4 * relevance) * (1 + (p / 10.0 - 0.5) * 0.4)), 6) as score from s) select * from c where score >= 0.3""", "vectors", "entries"))
def context_composites(spark, sf_dir):
    """Entries for a context by usefulness, similarity and stated priority, from 0.3 up."""
    q = vector.literal(_query_vector(spark, sf_dir))
    rows = views.vectors(spark, sf_dir).select(F.col("vec_id").alias("entry_id"), "v").join(views.entries(spark, sf_dir), "entry_id")
    score = scoring.context_composite(F.col("access_count") / 22.0, F.greatest(F.lit(0.0), vector.cosine(F.col("v"), q)), F.col("priority") / 10.0)
    return rows.select("entry_id", F.round(score, 6).alias("score")).filter("score >= 0.3")


def _levels_sql(bits: int) -> str:
    low, top = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return f"select vec_id, {bits} as bits, x, (greatest({low}, least({top}, floor((x - lo) / (hi - lo) * {top - low} + {low} + 0.5))) - {low}) / {top - low} * (hi - lo) + lo as y from c"


@query(sql(f"""+c as (select vec_id, unnest(v) as x, lo, hi from vectors, (select list_min(v) as lo, list_max(v) as hi from vectors order by vec_id limit 1)), e as ({_levels_sql(8)} union all {_levels_sql(16)})
select bits, count(distinct vec_id) as vectors, round(sqrt(avg((x - y) * (x - y))), 6) as rmse, round(max(abs(x - y)), 6) as worst, round(avg(abs(x - y)), 6) as mean, (1 - bits / 32.0)::double as saved from e group by bits""", "vectors"))
def quantize_widths(spark, sf_dir):
    """The error of codes of 8 and 16 bits over the range of the first vector, and the share of memory saved."""
    rows = views.vectors(spark, sf_dir)
    first = rows.orderBy("vec_id").limit(1).select(F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))  # one row
    at = rows.join(F.broadcast(first))
    widths = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), vector.recoded("v", "lo", "hi", b).alias("back")) for b in (8, 16)])).alias("w")
    gaps = at.select("v", widths).select("w.bits", F.explode(F.zip_with("v", "w.back", lambda x, y: F.abs(x - y))).alias("g"), F.size("v").alias("dim"))
    found = gaps.groupBy("bits").agg(F.sum(1 / F.col("dim")).alias("n"), F.avg(F.col("g") * F.col("g")).alias("mse"), F.max("g").alias("worst"), F.avg("g").alias("mean"))
    return found.select("bits", F.round("n").cast("long").alias("vectors"), F.round(F.sqrt("mse"), 6).alias("rmse"), F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"), (1 - F.col("bits") / 32.0).alias("saved"))


@query(sql(f"+one as (select v as q from vectors where vec_id = 0), s as (select vec_id, vec_id % 7 as session_id, round({_COS}, 6) as similarity from vectors, one where vec_id % 7 = 3) select * from s where similarity >= 0.05 order by similarity desc, vec_id limit 20", "vectors"))
def latent_session_search(spark, sf_dir):
    """The nearest vectors of one session above a least similarity."""
    q = vector.literal(_query_vector(spark, sf_dir))
    rows = views.vectors(spark, sf_dir).withColumn("session_id", F.col("vec_id") % 7).filter("session_id = 3")
    found = rows.select("vec_id", "session_id", F.round(vector.cosine(F.col("v"), q), 6).alias("similarity")).filter("similarity >= 0.05")
    return found.orderBy(F.desc("similarity"), "vec_id").limit(20)


def _cents(key: str) -> str:
    return f"(select node, list(value order by place) as v from (select {key} as node, place, avg(x) as value from (select label, unnest(v) as x, generate_subscripts(v, 1) as place from vectors) group by all) group by node)"


@query(sql(f"""+one as (select v as q from vectors where vec_id = 0), upper as (select node, round({_COS}, 6) as s from {_cents('label // 3')}, one), a as (select node from upper where s >= 0.0 order by s desc, node limit 2),
lower as (select node, round({_COS}, 6) as s from {_cents('label')}, one where node // 3 in (select node from a)), b as (select node from (select node, row_number() over (order by s desc, node) as k from lower where s >= 0.0) where k <= 2 * (select greatest(1, count(*)) from a))
select vec_id, label, round({_COS}, 6) as similarity from vectors, one where label in (select node from b) order by similarity desc, vec_id limit 40""", "vectors"))
def level_search(spark, sf_dir):
    """Summaries of two levels from the top down, at each those that are near enough, then the members."""
    q = vector.literal(_query_vector(spark, sf_dir))
    rows = views.vectors(spark, sf_dir).withColumn("above", F.floor(F.col("label") / 3))
    upper = vector.mean_vectors(rows, "above").select(F.col("above").alias("node"), F.lit(None).cast("long").alias("parent"), "v")
    lower = vector.mean_vectors(rows, "label").select(F.col("label").alias("node"), F.floor(F.col("label") / 3).alias("parent"), "v")
    near = vector.descend([upper, lower], q, factor=2, least=0.0)
    members = rows.filter(F.col("label").isin(near)).select("vec_id", "label", F.round(vector.cosine(F.col("v"), q), 6).alias("similarity"))
    return members.orderBy(F.desc("similarity"), "vec_id").limit(40)


_GLOBS = ("/de/*.html", "/en/?", "*/7*", "/ES/*")


@query("""with p as (select page_id, coalesce(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '') as path from pages)
select page_id, path from p where regexp_matches(path, '(?i)^(/de/.*\\.html|/en/.|.*/7.*|/ES/.*)$') or contains(path, '/de/.html') or contains(path, '/en/') or contains(path, '/7') or contains(path, '/ES/')""")
def path_rules(spark, sf_dir):
    """Pages whose path a rule's patterns cover."""
    path = F.coalesce(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path")
    return views.table(spark, sf_dir, "pages").select("page_id", path).filter(text.on_path(F.col("path"), _GLOBS))


_DATES = ("2024-01-15", "2024-01-15T10:30:00Z", "2024-1-5", "15.01.2024", "2024-01-15T10:30:00.123", "2024-01-15T10:30")


@query(f"""with d as (select event_id, [{', '.join(map(_lit, _DATES))}][(event_id % {len(_DATES)} + 1)::int] as said from events) select event_id, said, regexp_matches(said, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{3}})?Z?)?$') as is_date from d""")
def iso_dates(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(d) for d in _DATES]), (F.col("event_id") % len(_DATES) + 1).cast("int"))
    return views.table(spark, sf_dir, "events").select("event_id", said.alias("said"), text.iso_date(said).alias("is_date"))


_QUERIES = ('plain words', 'term AND "other"', "landscape", 'a-b NEAR/5 c*', '"quoted"', " ", "snake_case(x)")


@query(f"""with q as (select event_id, [{', '.join(map(_lit, _QUERIES))}][(event_id % {len(_QUERIES)} + 1)::int] as said from events), d as (select *, replace(said, '"', '""') as doubled from q)
select event_id, case when regexp_matches(doubled, '[\\s+\\-|*()]') then '"' || doubled || '"' else doubled end as phrase,
 case when trim(said) = '' then said when regexp_matches(doubled, '(?i)\\b(AND|OR|NOT|NEAR(?:/\\d+)?)\\b') then '"' || doubled || '"' else doubled end as literal,
 trim(regexp_replace(regexp_replace(said, '["*]', '', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')) as plain from d""")
def fts_escapes(spark, sf_dir):
    """Search texts as a phrase, without operators, and as plain tokens."""
    said = F.element_at(F.array(*[F.lit(q) for q in _QUERIES]), (F.col("event_id") % len(_QUERIES) + 1).cast("int"))
    rows = views.table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return rows.select("event_id", text.as_phrase(F.col("said")).alias("phrase"), text.without_operators(F.col("said")).alias("literal"), text.plain_tokens(F.col("said")).alias("plain"))


@query(sql("""+o as (select source_id as entry_id, count(*) as out_degree from relations group by 1), i as (select target_id as entry_id, count(*) as in_degree from relations group by 1), v as (select entry_id, count(*) as versions, max(version_s) as last_s from versions group by 1)
select entry_id, entry_type, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree, coalesce(versions, 0) as versions, last_s, access_count from entries left join o using (entry_id) left join i using (entry_id) left join v using (entry_id) where is_active""", "entries", "relations", "versions"))
def node_list(spark, sf_dir):
    """Active nodes with their degrees, history and accesses."""
    n = F.count(F.lit(1))
    edges = views.relations(spark, sf_dir)
    out, into = edges.groupBy(F.col("source_id").alias("entry_id")).agg(n.alias("out_degree")), edges.groupBy(F.col("target_id").alias("entry_id")).agg(n.alias("in_degree"))
    history = views.versions(spark, sf_dir).groupBy("entry_id").agg(n.alias("versions"), F.max("version_s").alias("last_s"))
    rows = views.entries(spark, sf_dir).filter("is_active").select("entry_id", "entry_type", "access_count")
    for side in (out, into, history):
        rows = rows.join(side, "entry_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("entry_id", "entry_type", zero("out_degree"), zero("in_degree"), zero("versions"), "last_s", "access_count")


@query("""with t as (select conv_id, turn, role, text, ceil(length(coalesce(text, '')) * 0.25)::bigint as tokens from conversations where turn is not null), l as (select conv_id, max(turn) + 1 as n from t group by 1),
w as (select t.*, n, greatest(0, n // 2 - 3) as start, n // 2 as done from t join l using (conv_id) where n - n // 2 >= 2), s as (select *, sum(tokens) over (partition by conv_id order by turn, role, text rows unbounded preceding) as running, row_number() over (partition by conv_id order by turn, role, text) as place from w where turn >= start and turn < start + 10),
k as (select * from s where running <= 400 or place = 1) select conv_id, start, max(turn) + 1 as stop, sum(tokens)::bigint as tokens, greatest(0, max(turn) + 1 - any_value(done)) as new_turns from k group by conv_id, start having sum(tokens) >= 50""")
def bounded_windows(spark, sf_dir):
    """The next window of each conversation, half of which was read: ten turns at most, three of them read before, of 50 to 400 tokens."""
    return sequence.next_windows(views.table(spark, sf_dir, "conversations"), least=50, most=400)


_GROUPS = "g as (select entry_id - entry_id % 5 as primary_id, entry_id as member from entries where is_active and entry_id % 5 <> 0 and entry_id - entry_id % 5 in (select entry_id from entries))"


def _groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Blocks of five entries as the groups to consolidate, and all contents."""
    rows = views.entries(spark, sf_dir)
    first = F.col("entry_id") - F.col("entry_id") % 5
    groups = rows.filter("is_active and entry_id % 5 <> 0").select(first.alias("primary"), F.col("entry_id").alias("member"))
    known = rows.select(F.col("entry_id").alias("primary"))
    return groups.join(known, "primary", "left_semi"), rows.select(F.col("entry_id").alias("id"), "content")


@query(sql(f"""+{_GROUPS}, s as (select entry_id as id, place, trim(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) as statement from (select entry_id, unnest(string_split_regex(content, '[.!?]+')) as piece, generate_subscripts(string_split_regex(content, '[.!?]+'), 1) - 1 as place from entries where content is not null)),
k as (select * from s where length(statement) > 10), a as (select primary_id, member, place, statement from g join k on k.id = member),
f as (select *, row_number() over (partition by primary_id, lower(statement) order by member, place) as n from a where not exists (select 1 from k where k.id = a.primary_id and lower(k.statement) = lower(a.statement)))
select primary_id, member, place::int as place, statement from f where n = 1""", "entries"))
def consolidate_merge(spark, sf_dir):
    """The statements that merging a group adds to its primary entry, each once and in order."""
    groups, contents = _groups(spark, sf_dir)
    return maintenance.merged_statements(groups, contents).withColumnRenamed("primary", "primary_id")


@query(sql(f"""+{_GROUPS} select case primary_id % 3 when 1 then primary_id else member end as source_id, case primary_id % 3 when 1 then member else primary_id end as target_id,
 ['merged_into', 'related', 'consolidated_into'][(primary_id % 3 + 1)::int] as relation_type, primary_id % 3 = 1 as stays_active from g""", "entries"))
def consolidate_relations(spark, sf_dir):
    """The relations that merging, abstracting and removing duplicates leave, and whether a member stays active."""
    groups, _ = _groups(spark, sf_dir)
    action = F.element_at(F.array(F.lit("merge"), F.lit("abstract"), F.lit("dedupe")), (F.col("primary") % 3 + 1).cast("int"))
    return maintenance.consolidation_relations(groups.withColumn("action", action))
