"""Queries that put several searches together: the full search, ranked snippets, best matches of each type, budgets by intent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import fulltext, graph, policies, vector
from ..registry import query
from ..sources import views
from ..sources.views import AS_OF_HOURS, sql
from .learning_queries import _NET
from .retrieval_queries import _SCOPED, session_chain
from .search import SearchPlan, Signals, search_all
from .text_queries import _bm25_sql
from .vector_queries import _COS, _query_vector

_TERMS = ["onat", "heit", "nder"]
_FTS = _bm25_sql("").strip().removeprefix("with ").rstrip() + ", fts as (select doc_id as entry_id, s / (1 + s) as fts from scored)"
_TAGS = ("en", "src0", "src1", "src2", "src3")
_INTENT = "debug"
_TYPE_WEIGHT = "case entry_type " + " ".join(f"when '{t}' then {w}" for t, w in policies.INTENT_TYPE_WEIGHTS[_INTENT].items()) + " else 1.0 end"


def _text_scores(spark, sf_dir):
    s = F.col("score")
    return fulltext.bm25(views.table(spark, sf_dir, "documents"), "text", _TERMS).select(F.col("doc_id").alias("entry_id"), (s / (1 + s)).alias("fts"))


@query(sql(f"""+{_SCOPED}, {_FTS}, {_NET},
one as (select v as q from vectors where vec_id = 0), near as (select vec_id as entry_id, round({_COS}, 6) as sim from vectors, one where round({_COS}, 6) >= 0.1),
rel as (select target_id as entry_id from relations where source_id = 7 union select source_id from relations where target_id = 7),
inc as (select entry_id, count(distinct lower(tag)) as n from entry_tags where lower(tag) in ({', '.join(map(repr, _TAGS))}) group by 1),
based as (select s.*, fts, sim, case when rel.entry_id is not null then 50.0 else 0.0 end + 10.0 * inc.n + 20.0 * (4 - place) / 4.0 + case when fts is not null then 30.0 else 0.0 end + case when entry_type = 'guideline' then priority * 0.2 else 0.0 end as base
 from scoped s join inc using (entry_id) left join fts using (entry_id) left join near using (entry_id) left join rel using (entry_id) where fts is not null or sim is not null),
head as (select *, round(base + 30.0 * coalesce(fts, 0.0), 6) as light from based order by light desc, entry_id limit 45)
select h.entry_id, entry_type, round(light, 6)::double as light_score, round((base + coalesce(40.0 * (0.7 * sim + 0.3 * coalesce(fts, 0.0)), 0.0) + exp(-ln(2.0) * ((744 - born_h) / 24.0) / 30.0) * 10.0)
 * case when positive - negative > 0 then 1 + least(0.02 * positive, 0.1) when positive - negative < 0 then 1 - least(0.1 * abs(positive - negative), 0.5) else 1.0 end * {_TYPE_WEIGHT}, 6)::double as score
from head h left join net n on n.entry_id = h.entry_id order by score desc, born_h desc, h.entry_id limit 30""", "entries", "entry_tags", "relations", "vectors", "feedback"))
def search_pipeline(spark, sf_dir):
    """Scope, tags, full text, similarity, relations, feedback and intent in one search, in two phases."""
    near = views.vectors(spark, sf_dir).select(F.col("vec_id").alias("entry_id"), F.round(vector.cosine(F.col("v"), vector.literal(_query_vector(spark, sf_dir))), 6).alias("sim")).filter("sim >= 0.1")
    rel = graph.reachable(spark.createDataFrame([(7,)], "node long"), views.relations(spark, sf_dir), 1).select(F.col("node").alias("entry_id"))
    signals = Signals(_text_scores(spark, sf_dir), near, rel, views.feedback(spark, sf_dir)[2], _INTENT)
    found = search_all(SearchPlan(tags_include=_TAGS, limit=30), signals, views.entries(spark, sf_dir), views.entry_tags(spark, sf_dir), session_chain(spark, sf_dir), 4, AS_OF_HOURS)
    return found.select("entry_id", "entry_type", "light_score", "score")


_HIT = "regexp_matches(lower(t), '(^|[^a-z0-9à-öø-ÿ])(heit|nder|onat)([^a-z0-9à-öø-ÿ]|$)')"


@query(f"""with {_FTS}, head as (select doc_id, round(s, 6) as score from scored order by score desc, doc_id limit 25),
w as (select doc_id, score, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') as w from head join documents using (doc_id)),
p as (select *, greatest(list_position(list_transform(w, lambda t: {_HIT}), true) - 8, 1) as start from w)
select doc_id, score, case when start > 1 then '... ' else '' end || array_to_string(list_transform(w[start:start + 31], lambda t: case when {_HIT} then '<mark>' || t || '</mark>' else t end), ' ')
 || case when start + 32 <= len(w) then ' ...' else '' end as snippet from p""")
def fts_snippets(spark, sf_dir):
    """The best matches with 32 words around the first hit, hits marked; only the ranked texts are read again."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    top = fulltext.bm25(docs, "text", _TERMS).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)
    return docs.join(F.broadcast(top), "doc_id").select("doc_id", "score", fulltext.snippet(F.col("text"), _TERMS).alias("snippet"))  # 25 rows


@query(sql(f"""+{_FTS} select entry_id, entry_type, place, round(fts, 6) as fts from (select entry_id, entry_type, fts, row_number() over (partition by entry_type order by round(fts, 9) desc, entry_id)::int as place
 from fts join entries using (entry_id) where is_active) where place <= 10""", "entries"))
def fts_topn_by_type(spark, sf_dir):
    """The ten best matches of each type; map tasks keep no more of a type."""
    types = views.entries(spark, sf_dir).filter("is_active").select("entry_id", "entry_type")
    order = Window.partitionBy("entry_type").orderBy(F.desc(F.round("fts", 9)), "entry_id")
    placed = _text_scores(spark, sf_dir).join(types, "entry_id").withColumn("place", F.row_number().over(order)).filter("place <= 10")
    return placed.select("entry_id", "entry_type", "place", F.round("fts", 6).alias("fts"))


_ALLOCATIONS = policies.allocations()


@query(sql(f"""+a(intent, complexity, entry_type, allocation, most) as (values {', '.join(map(str, _ALLOCATIONS))}),
r as (select entry_type, tokens, sum(tokens) over w as running, row_number() over w as place from (select *, ceil(length(content) * 0.25)::bigint as tokens from entries where is_active)
 window w as (partition by entry_type order by priority desc, entry_id rows unbounded preceding))
select intent, complexity, a.entry_type, allocation, most, count(tokens) as entries, coalesce(sum(tokens), 0)::bigint as tokens from a left join r on r.entry_type = a.entry_type and running <= allocation and place <= most group by all""", "entries"))
def budget_by_intent(spark, sf_dir):
    """What fits into each type's share of the budget that each intent's complexity gives; one pass for all intents."""
    rows = views.entries(spark, sf_dir).filter("is_active").select("entry_id", "entry_type", "priority", scoring.token_estimate(F.col("content")).alias("tokens"))
    shares = spark.createDataFrame(_ALLOCATIONS, "intent string, complexity string, entry_type string, allocation long, most long")
    kept = policies.within_budget(rows, max(a[3] for a in _ALLOCATIONS)).select(F.col("entry_type").alias("_type"), "tokens", "running", "place")
    kept = kept.filter(F.col("place") <= max(a[4] for a in _ALLOCATIONS))
    fits = shares.join(kept, (F.col("_type") == F.col("entry_type")) & (F.col("running") <= F.col("allocation")) & (F.col("place") <= F.col("most")), "left")
    by = fits.groupBy("intent", "complexity", "entry_type", "allocation", "most")
    return by.agg(F.count("tokens").alias("entries"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
