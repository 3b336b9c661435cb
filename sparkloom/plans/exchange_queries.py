"""Queries of export and import."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..shared import new_path
from ..sources import exchange, session_files, views
from ..sources.views import sql

_TURNS = "t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations)"


def _turns(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query(f"with {_TURNS} select conv_id, to_json({{'messages': list({{'role': role, 'content': text}} order by turn, role, text)}})::varchar as line from t group by conv_id")
def export_openai(spark, sf_dir):
    return exchange.conversation_lines(_turns(spark, sf_dir), "openai")


@query(f"""with {_TURNS} select conv_id, to_json({{'conversations': list({{'from': case role when 'user' then 'human' when 'assistant' then 'gpt' else role end, 'value': text}} order by turn, role, text)}})::varchar as line from t group by conv_id""")
def export_sharegpt(spark, sf_dir):
    return exchange.conversation_lines(_turns(spark, sf_dir), "sharegpt")


@query(f"""with {_TURNS} select conv_id, to_json({{'system': coalesce(string_agg(text, chr(10) order by turn) filter (where role = 'system'), ''),
 'messages': coalesce(list({{'role': role, 'content': text}} order by turn, role, text) filter (where role <> 'system'), [])}})::varchar as line from t group by conv_id""")
def export_anthropic(spark, sf_dir):
    return exchange.conversation_lines(_turns(spark, sf_dir), "anthropic")


@query(f"""with {_TURNS} select a.conv_id, a.turn, to_json({{'instruction': u.text, 'input': '', 'output': a.text}})::varchar as line
 from t a join t u on u.conv_id = a.conv_id and u.turn + 1 = a.turn where a.role = 'assistant' and u.role = 'user'""")
def export_alpaca(spark, sf_dir):
    return exchange.alpaca_lines(_turns(spark, sf_dir))


@query(sql("select entry_id, to_json({'entry_id': entry_id, 'entry_type': entry_type, 'title': title, 'category': category, 'priority': priority})::varchar as line from entries where title is not null and category is not null", "entries"))
def export_json(spark, sf_dir):
    return exchange.entry_lines(views.entries(spark, sf_dir).filter("title is not null and category is not null"))


@query(sql("select entry_id, '## ' || coalesce(title, '-') || chr(10) || chr(10) || '- type: ' || entry_type || chr(10) || '- category: ' || coalesce(category, '-') || chr(10) || '- priority: ' || priority as line from entries", "entries"))
def export_markdown(spark, sf_dir):
    return exchange.markdown(views.entries(spark, sf_dir))


@query(sql("select entry_id, '- entry_id: \"' || entry_id || '\"' || chr(10) || '  entry_type: \"' || entry_type || '\"' || chr(10) || '  title: ' || coalesce(to_json(title)::varchar, 'null') || chr(10) || '  category: ' || coalesce(to_json(category)::varchar, 'null') as line from entries", "entries"))
def export_yaml(spark, sf_dir):
    return exchange.yaml(views.entries(spark, sf_dir))


@query(sql("select entry_id, to_json({'path': '/tools/' || entry_id, 'item': {'post': {'operationId': 'tool_' || entry_id, 'summary': coalesce(title, '')}}})::varchar as line from entries where entry_type = 'tool'", "entries"))
def export_openapi(spark, sf_dir):
    return exchange.openapi_paths(views.entries(spark, sf_dir).filter("entry_type = 'tool'"))


# An import: the guideline and tool entries again with other priorities, some without a category, and new ids.
_SIDES = """a as (select entry_id, category, priority from entries where entry_type in ('tool', 'knowledge')),
b as (select entry_id, case when priority > 50 then 'imported' end as category, priority + 1 as priority from entries where entry_type in ('tool', 'guideline'))"""


def _import(strategy: str, both: str, outcome: str) -> None:
    @query(sql(f"""+{_SIDES} select entry_id, case when a.entry_id is null then b.category when b.entry_id is null then a.category else {both.format(c='category')} end as category,
 case when a.entry_id is null then b.priority when b.entry_id is null then a.priority else {both.format(c='priority')} end as priority,
 case when b.entry_id is null then 'kept' when a.entry_id is null then 'inserted' else '{outcome}' end as outcome from a full join b using (entry_id)""", "entries"), name=f"import_{strategy}")
    def run(spark, sf_dir):
        rows = views.entries(spark, sf_dir)
        old = rows.filter("entry_type in ('tool', 'knowledge')").select("entry_id", "category", "priority")
        new = rows.filter("entry_type in ('tool', 'guideline')").select("entry_id", F.when(F.col("priority") > 50, "imported").alias("category"), (F.col("priority") + 1).alias("priority"))
        return exchange.merge_import(old, new, "entry_id", strategy)


_import("skip", "a.{c}", "skipped")
_import("update", "coalesce(b.{c}, a.{c})", "updated")
_import("replace", "b.{c}", "replaced")


def write_session_files(spark, sf_dir, base):
    """The conversations as a transcript tree: each line of a text is a part, and every fifth turn is a tool call instead."""
    rows = views.table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    message = F.concat_ws("-", F.lit("m"), "conv_id", "turn", "n")
    named = rows.select("*", message.alias("m"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("s"), (F.col("turn") % 5 == 4).alias("tool"))
    sessions = named.groupBy("s").agg(F.min("turn").alias("first"))
    sessions.select(F.col("s").alias("id"), F.concat(F.lit("slug "), F.col("s")).alias("slug"), F.lit("/work").alias("directory"), F.struct((F.col("first") * 1000).alias("created")).alias("time")).write.json(f"{base}/session/p")
    named.select(F.col("m").alias("id"), F.col("s").alias("sessionID"), "role", F.struct((F.col("turn") * 1000).alias("created")).alias("time")).write.json(f"{base}/message/all")
    texts = named.filter("not tool").select("m", "s", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    texts = texts.select(F.concat_ws("-", "m", F.lpad(F.col("k").cast("string"), 6, "0")).alias("id"), F.col("s").alias("sessionID"), F.col("m").alias("messageID"), F.lit("text").alias("type"), "text")
    texts.write.json(f"{base}/part/texts")
    state = F.struct(F.when(F.col("turn") % 2 == 0, "completed").otherwise("error").alias("status"), F.struct(F.substring("text", 1, 200).alias("q")).alias("input"), F.col("text").alias("output"))
    tools = named.filter("tool").select(F.concat("m", F.lit("-t")).alias("id"), F.col("s").alias("sessionID"), F.col("m").alias("messageID"), F.lit("tool").alias("type"), F.lit("search").alias("tool"), state.alias("state"))
    tools.write.json(f"{base}/part/tools")


@query("""with r as (select *, row_number() over (partition by conv_id, turn order by role nulls first, text nulls first) as n from conversations where conv_id is not null and turn is not null),
m as (select 's' || conv_id as session_id, 'm-' || conv_id || '-' || turn || '-' || n as message_id, case when role = 'user' then 'user' else 'assistant' end as role, turn, text, turn % 5 = 4 as tool,
 '{"q":' || to_json(substr(text, 1, 200))::varchar || '}' as given from r)
select session_id, message_id, role, turn * 1000 as created_ms, case when tool then '[search' || case when turn % 2 = 0 then '' else ' (error)' end || ': ' || case when length(given) > 100 then substr(given, 1, 100) || '...' else given end || ']'
 else array_to_string(list_filter(string_split(text, chr(10)), lambda t: t <> ''), chr(10)) end as content, case when tool then 1 else 0 end as calls
from m where tool or len(list_filter(string_split(text, chr(10)), lambda t: t <> '')) > 0""")
def session_messages(spark, sf_dir):
    """Conversations written as a tree of transcript files, and read back by a stream as messages."""
    base, store = new_path(spark, "sessions"), new_path(spark, "session-store")
    write_session_files(spark, sf_dir, base)
    found = session_files.sync(spark, base, store, lines=True)
    return found.select("session_id", "message_id", "role", F.unix_millis("at").alias("created_ms"), "content", F.size("calls").alias("calls"))
