"""Queries of pattern-based text signals; their SQL is made from the same pattern tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signals
from ..registry import query
from ..sources import views
from ..sources.views import sql


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_lit(pattern)}, 'i')"


def _any(column: str, patterns) -> str:
    return "(" + " or ".join(_hit(column, p) for p in patterns) + ")"


def _entry_hit(pattern: str) -> str:
    if "(?!" not in pattern:
        return _hit("text", pattern)
    # no look-ahead in this SQL: some word after make must be none of those listed
    return r"len(list_filter(regexp_extract_all(text, '\bmake\s+(\w+)', 1, 'i'), lambda w: not regexp_matches(w, '^(sure|it|the|a|an|this|that|sense|changes?|progress|use|room)', 'i'))) > 0"


_TYPED = " union all ".join(f"select text, {k} as k, '{t}' as t, {w}::double as w from texts where {_entry_hit(p)}" for k, (t, w, p) in enumerate(signals.ENTRY_PATTERNS))


@query(sql(f"""+texts as (select distinct text from messages), hits as ({_TYPED}),
best as (select text, arg_max(t, w * 1000 - k) as t, max(w) as w from hits group by text),
more as (select b.text, b.t, b.w, max(h.w) filter (where h.t <> b.t and h.w > 0.6) as rival, count(*) filter (where h.t = b.t) as same from best b join hits h using (text) group by all),
val as (select text, t, case when same > 1 then least(0.95::double, c + 0.05::double * (same - 1)) else c end as c from (select *, case when w - rival < 0.2 then w * (0.8::double + (w - rival) * 2) else w end as c from more))
select event_id, coalesce(t, 'knowledge') as type, case when t is null then 0.5 else floor(c * 100 + 0.5) / 100 end::double as confidence from messages left join val using (text)""", "messages"))
def entry_type_classify(spark, sf_dir):
    return signals.once_each(views.messages(spark, sf_dir), ["text"], signals.entry_type).select("event_id", "type", "confidence")


_INTENTS = " ".join(f"when {_any('lower(text)', patterns)} then '{name}'" for name, _, patterns in signals.QUERY_INTENTS)


@query(sql(f"select event_id, case {_INTENTS} else 'explore' end as intent from messages", "messages"))
def query_intent(spark, sf_dir):
    return views.messages(spark, sf_dir).select("event_id", signals.query_intent(F.col("text")).alias("intent"))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(lower(text), {_lit(pattern)}))"


_GROUPS = ["(" + " + ".join(_count(rf"\b{w.replace(' ', chr(92) + 's+')}\b") for w in words) + ")" for words in signals.COMPLEXITY_WORDS.values()]
_COMPLEX = " + ".join(f"case when {g} > 0 then 0.2::double + least(0.15::double, ({g} - 1) * 0.05::double) else 0 end" for g in _GROUPS)


@query(sql(f"select event_id, round(least(1.0::double, {_COMPLEX}), 6) as score from messages", "messages"))
def complexity_signals(spark, sf_dir):
    scored = lambda texts: texts.withColumn("score", F.round(signals.complexity(F.col("text")), 6))
    return signals.once_each(views.messages(spark, sf_dir), ["text"], scored).select("event_id", "score")


def _score(name: str) -> str:
    parts = [f"case when {_hit('recent', p)} then {w * signals._match_size(p)} else 0 end" for w, p in signals.OUTCOME_PATTERNS[name]]
    if name == "success":
        parts += [f"case when {_hit('whole', p)} then {w * 0.3 * min(signals._match_size(p), 3)} else 0 end" for w, p in signals.OUTCOME_PATTERNS[name]]
    return f"round(least(1.0, ({' + '.join(parts)})::double), 6)"


@query(sql(f"""+n as (select *, row_number() over (partition by user_id order by us desc, event_id desc) as back, us // 86400000000 as day from messages),
t as (select user_id, string_agg(text, ' ' order by us, event_id) filter (where back <= 5) as recent, string_agg(text, ' ' order by us, event_id) filter (where back <= 50) as whole from n group by 1),
s as (select user_id, {_score('success')} as a, {_score('failure')} as b, {_score('partial')} as c from t)
select user_id, case when greatest(a, b, c) < 0.15 then 'unknown' when a > b and a > c then 'success' when b > a and b > c then 'failure' else 'partial' end as outcome from s""", "messages"))
def outcome_inference(spark, sf_dir):
    """How each user's talk ended, from their last five messages and, less, the last fifty."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    last = views.messages(spark, sf_dir).withColumn("back", F.row_number().over(newest)).filter("back <= 50")
    text = lambda most: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("back") <= most, F.struct("us", "event_id", "text")))), lambda s: s["text"]), " ")
    talk = last.groupBy("user_id").agg(text(5).alias("recent"), text(50).alias("whole"))
    return talk.select("user_id", signals.outcome(F.col("recent"), F.col("whole")).alias("outcome"))


def _boost_sql() -> str:
    applies = lambda types, patterns: f"({_any('text', patterns)} and type in ({', '.join(map(_lit, types))}))"
    total = " + ".join(f"case when {applies(t, p)} then {b}::double else 0 end" for b, _, t, p in signals.BOOSTS)
    n = " + ".join(f"case when {applies(t, p)} then 1 else 0 end" for _, _, t, p in signals.BOOSTS)
    most = ", ".join(f"case when {_any('text', p)} then {m}::double else 1 end" for _, m, _, p in signals.BOOSTS)
    return f"round(least({most}, 1.0::double, 0.5::double + ({total}) / sqrt(greatest({n}, 1))), 6)"


@query(sql(f"+typed as (select event_id, text, case when event_id % 2 = 0 then 'knowledge' else 'guideline' end as type from messages) select event_id, {_boost_sql()} as confidence from typed", "messages"))
def confidence_boosts(spark, sf_dir):
    kind = F.when(F.col("event_id") % 2 == 0, "knowledge").otherwise("guideline")
    raised = lambda texts: texts.withColumn("confidence", F.round(signals.boosted(F.col("text"), F.col("kind"), F.lit(0.5)), 6))
    return signals.once_each(views.messages(spark, sf_dir).withColumn("kind", kind), ["text", "kind"], raised).select("event_id", "confidence")


_SEVERAL = " ".join(f"when {_hit('lower(text)', p)} then '{t}'" for t, _, p in signals.SEVERAL)


@query(sql(f"select event_id, case {_SEVERAL} when length(text) - length(replace(text, '?', '')) > 1 then 'multi_topic' else 'simple' end as kind from messages", "messages"))
def question_kinds(spark, sf_dir):
    return views.messages(spark, sf_dir).select("event_id", signals.several(F.col("text")).alias("kind"))


_DECISIONS = " + ".join(f"contains(lower(text), {_lit(w)})::int" for w in signals.DECISION_WORDS)


@query(sql(f"""select event_id, round(least(1.0::double, 0.3::double + case when len(regexp_split_to_array(text, '\\s+')) > 100 then 0.2 when len(regexp_split_to_array(text, '\\s+')) > 50 then 0.1 else 0 end
 + least((length(text) - length(replace(text, '```', ''))) / 6.0 * 0.1, 0.2) + least(({_DECISIONS}) * 0.05, 0.25)), 6)::double as score from messages""", "messages"))
def decision_relevance(spark, sf_dir):
    return views.messages(spark, sf_dir).select("event_id", F.round(signals.relevance(F.col("text"), F.lit("user")), 6).alias("score"))


@query(sql(f"""+m as (select event_id as entry_id, text as content, 'guideline' as entry_type from messages union all select -1 - entry_id, content, entry_type from entries where content is not null), l as (select *, len(string_split(content, chr(10))) as lines from m)
select entry_id, 'bug_report_in_guideline' as flag, 'high' as severity from l where entry_type = 'guideline' and {_hit('content', signals.BUG_WORDS)} and not {_hit('content', signals.RULE_WORDS)}
union all select entry_id, 'overly_long_content', 'medium' from l where length(content) > 10000
union all select entry_id, 'inconsistent_formatting', 'low' from l where length(content) / lines > 200 and lines > 10""", "messages", "entries"))
def red_flags(spark, sf_dir):
    said = views.messages(spark, sf_dir).select(F.col("event_id").alias("entry_id"), F.col("text").alias("content"), F.lit("guideline").alias("entry_type"))
    held = views.entries(spark, sf_dir).filter("content is not null").select((-1 - F.col("entry_id")).alias("entry_id"), "content", "entry_type")
    return signals.red_flags(said.unionByName(held))


@query("""with recursive e as (select event_type as key, value < 300 as ok, row_number() over (partition by event_type order by ts, event_id) as n from events),
r as (select key, 0::bigint as n, 1.0::double as m from (select distinct key from e) union all select r.key, e.n, least(1.15, greatest(0.7, r.m * 0.9 + 0.1 * case when ok then 1.0 else 0.5 end))::double from r join e on e.key = r.key and e.n = r.n + 1)
select key, round(arg_max(m, n), 6) as multiplier from r group by key""")
def pattern_feedback(spark, sf_dir):
    """A weight for each type after all its feedback in order, day by day."""
    events = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"), F.to_date("ts").alias("block"), F.struct("ts", "event_id").alias("at"), (F.col("value") < 300).alias("correct")
    )
    return signals.pattern_feedback(events).select("key", F.round("multiplier", 6).alias("multiplier"))


def _trigger_sql() -> str:
    some = lambda patterns: "(" + " or ".join(f"regexp_matches(text, {_lit(p)}, 'is')" for p in patterns) + ")"
    return " union all ".join(f"select event_id, '{n}' as \"trigger\", {c}::double as confidence, '{k}' as suggested_type, {b}::int as boost from messages where {some(p)}" for n, c, k, b, p in signals.TRIGGERS)


@query(sql(_trigger_sql(), "messages"))
def extraction_triggers(spark, sf_dir):
    return signals.once_each(views.messages(spark, sf_dir), ["text"], signals.triggers).select("event_id", "trigger", "confidence", "suggested_type", "boost")


def _named_sql() -> str:
    parts = []
    for kind, ignores_case, pattern in signals.NAMED:
        value = "v" if kind in signals.KEPT_CASE else "lower(v)"
        keep = "where length(v) between 3 and 50 and ((regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')) or contains(v, '_')) and lower(v) not in (" + ", ".join(map(_lit, signals.NO_FUNCTIONS)) + ")" if kind == "FUNCTION_NAME" else ""
        found = f"unnest(regexp_extract_all(text, {_lit(('(?i)' if ignores_case else '') + pattern)}, 1))"
        parts.append(f"select distinct event_id, '{kind}' as kind, {value} as value from (select event_id, {found} as v from told) {keep}")
    return " union all ".join(parts)


_TOLD = ("See When ./src/main.rs and loadConfig() in @scope/pkg-one", "TypeError: fetch_all failed at https://Example.org/A?b=1 with ENOENT", "run git commit, then npm install lodash/fp", "nothing here")
_TOLD_SQL = f"told as (select event_id, [{', '.join(map(_lit, _TOLD))}][(event_id % 4 + 1)::int] || ' ' || event_type as text from events)"


@query(f"with {_TOLD_SQL} {_named_sql()}")
def named_things(spark, sf_dir):
    """Paths, functions, packages, addresses, error codes and commands in technical messages."""
    said = F.element_at(F.array(*[F.lit(t) for t in _TOLD]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = views.table(spark, sf_dir, "events").select("event_id", F.concat(said, F.lit(" "), F.col("event_type")).alias("text"))
    return signals.named_things(rows).select("event_id", "kind", "value")


_SURE = """case when kind = 'FILE_PATH' and regexp_matches(value, '\\.\\w{1,5}$') then 0.9 when kind = 'FUNCTION_NAME' and (length(value) >= 5 and (regexp_matches(value, '^[a-z].*[A-Z]') or contains(value, '_')) or regexp_matches(value, '^[A-Z].*[a-z].*[A-Z]')) then 0.85
 when kind = 'PACKAGE_NAME' then case when starts_with(value, '@') then 0.95 when contains(value, '/') then 0.9 else 0.75 end when kind = 'URL' then 0.95 when kind = 'ERROR_CODE' and regexp_matches(value, '(error|exception)$', 'i') then 0.9
 when kind = 'ERROR_CODE' and regexp_matches(value, '^E[A-Z0-9]+$') then 0.85 when kind = 'COMMAND' and regexp_matches(value, '^(npm|yarn|pnpm|git|docker)\\s') then 0.9 else 0.7 end::double"""
_MORE = """case when kind = 'FUNCTION_NAME' and len(words) > 1 then list_concat(words, [array_to_string(words, '_'), array_to_string(words, '-'), array_to_string(words, '')])
 when kind = 'FILE_PATH' then list_filter([regexp_extract(value, '[^/]*$'), string_split(regexp_extract(value, '[^/]*$'), '.')[1]], lambda x: x <> '')
 when kind = 'PACKAGE_NAME' then list_concat(case when starts_with(value, '@') and contains(value, '/') then string_split(substr(value, 2), '/')[1:2] else [] end, list_filter(string_split_regex(replace(value, '@', ''), '[-/]'), lambda x: length(x) > 2))
 when kind = 'ERROR_CODE' and regexp_matches(value, '^[eE].') then [substr(value, 2)]
 when kind = 'COMMAND' and regexp_matches(value, '\\s') then [string_split_regex(value, '\\s+')[1], array_to_string(string_split_regex(value, '\\s+')[2:], ' ')] else [] end"""


@query(f"""with {_TOLD_SQL}, named as ({_named_sql()}), w as (select *, list_filter(string_split(regexp_replace(value, '([A-Z])', '_\\1', 'g'), '_'), lambda x: x <> '') as words from named)
select event_id, kind, value, {_SURE} as confidence, unnest(list_distinct(list_concat([value, lower(value)], list_transform({_MORE}, lambda x: lower(x))))) as variant from w""")
def named_variants(spark, sf_dir):
    """What technical messages name, how sure that is, and the spellings under which it may be found."""
    kind, value = F.col("kind"), F.col("value")
    return named_things(spark, sf_dir).select("event_id", "kind", "value", signals.confidence(kind, value).alias("confidence"), F.explode(signals.variants(kind, value)).alias("variant"))


_ASKED = ("We are working on the parser project.", "It is in the cache module of the loom repository", "How do I sort rows? Can you also add an index?", "The other repo has it, the cache has the cache")
_ASKED_SQL = f"asked as (select event_id, user_id, [{', '.join(map(_lit, _ASKED))}][(event_id % 4 + 1)::int] as text from events)"
_PROJECTS_SQL = " union all ".join(f"select user_id, 'project' as kind, value from (select user_id, unnest(regexp_extract_all(text, {_lit(p)}, 1, 'i')) as value from asked) where lower(value) not in ({', '.join(map(_lit, signals.NO_PROJECTS))})" for p in signals.PROJECT_PATTERNS)
_QUESTIONS_SQL = " union all ".join(f"select user_id, 'question', trim(value) from (select user_id, unnest(regexp_extract_all(text, {_lit(p)}, 1, 'i')) as value from asked) where trim(value) <> ''" for p in signals.QUESTION_PATTERNS)


def _asked(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(t) for t in _ASKED]), (F.col("event_id") % 4 + 1).cast("int"))
    return views.table(spark, sf_dir, "events").select("event_id", "user_id", said.alias("text"))


@query(f"with {_ASKED_SQL} select distinct * from ({_PROJECTS_SQL} union all {_QUESTIONS_SQL})")
def spoken_of(spark, sf_dir):
    """Projects and topics of questions of each user."""
    return signals.spoken_of(_asked(spark, sf_dir), "user_id")


@query(f"with {_ASKED_SQL}, n as (select event_id, text, len(regexp_extract_all(text, '\\bcache\\b', 0, 'i')) as n from asked) select event_id, round(least(1.0::double, 0.3::double + n * 10.0::double / length(text)), 6) as confidence from n where n > 0")
def pattern_mentions(spark, sf_dir):
    return signals.mentions(_asked(spark, sf_dir), "cache").select("event_id", "confidence")


def _bands_sql() -> str:
    from ..registry import ORACLES

    return f"select event_id, score, case when score >= 0.7 then 'high' when score >= 0.4 then 'medium' else 'low' end as band from ({ORACLES['decision_relevance']})"


@query(_bands_sql())
def relevance_bands(spark, sf_dir):
    return decision_relevance(spark, sf_dir).withColumn("band", signals.band(F.col("score")))


@query("""with r as (select event_type as agent_type, event_type <> 'error' as success, case when event_type <> 'signup' then value end as ms from events)
select agent_type, count(*) as n, round(avg(success::int), 6) as success_rate, round(coalesce(sum(ms), 0) / count(*), 4) as avg_ms from r group by 1
union all select 'all', count(*), round(avg(success::int), 6), round(coalesce(avg(ms), 0), 4) from r""")
def subagent_stats(spark, sf_dir):
    """Runs, success rate and mean duration of each kind of helper; a kind's mean is over all its runs, the mean of all over timed ones."""
    rows = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("agent_type"), (F.col("event_type") != "error").cast("int").alias("ok"), F.when(F.col("event_type") != "signup", F.col("value")).alias("ms")
    )
    n, rate = F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("success_rate")
    by = rows.groupBy("agent_type").agg(n, rate, F.round(F.coalesce(F.sum("ms"), F.lit(0.0)) / F.count(F.lit(1)), 4).alias("avg_ms"))
    return by.unionByName(rows.agg(n, rate, F.round(F.coalesce(F.avg("ms"), F.lit(0.0)), 4).alias("avg_ms")).withColumn("agent_type", F.lit("all")))
