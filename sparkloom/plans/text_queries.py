"""Queries of full-text search, text measures, duplicates and text classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, fulltext
from ..registry import query
from ..sources import views
from ..sources.views import sql

_TERMS = ("thing", "onat", "heit")
_WORDS = "words as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda t: length(t) > 0) as w from documents)"


def _docs(spark, sf_dir):
    return views.table(spark, sf_dir, "documents")


@query(f"with {_WORDS} select doc_id from words where len(list_filter(w, lambda t: starts_with(t, 'thoun') or t = 'sandbox' or t = 'heitver')) > 0")
def fts_match_or(spark, sf_dir):
    wanted = fulltext.pattern_terms(text.fts_terms('the "thoun"* sandbox, heitver', fulltext.STOP_WORDS))
    return _docs(spark, sf_dir).filter(F.exists(fulltext.tokens(F.col("text")), lambda t: fulltext.term_match(t, wanted))).select("doc_id")


def _bm25_sql(tail: str) -> str:
    return f"""with {_WORDS}, st as (select count(*)::double as n, avg(len(w)) as mean from words),
hits as (select doc_id, len(w) as doc_len, unnest(list_filter(w, lambda t: t in ('onat', 'heit', 'nder'))) as term from words),
tf as (select doc_id, doc_len, term, count(*) as tf from hits group by all), df as (select term, count(*) as df from tf group by 1),
scored as (select doc_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean))) as s from tf join df using (term), st group by 1)
{tail}"""


@query(_bm25_sql("select doc_id, round(s, 6) as score, round(s / (1 + s), 6) as normal from scored order by score desc, doc_id limit 25"))
def fts_bm25_topk(spark, sf_dir):
    s = F.col("score")
    found = fulltext.bm25(_docs(spark, sf_dir), "text", ["onat", "heit", "nder"])
    return found.select("doc_id", F.round(s, 6).alias("score"), F.round(s / (1 + s), 6).alias("normal")).orderBy(F.desc("score"), "doc_id").limit(25)


@query(f"""with {_WORDS}, hits as (select doc_id, max(case when list_contains(w, 'onat') then 1.0 else 0.0 end) as a, max(case when list_contains(w, 'heit') then 0.7 else 0.0 end) as b from words group by 1)
select doc_id, greatest(a, b)::double as score from hits where greatest(a, b) > 0""")
def fts_multi_query_max(spark, sf_dir):
    score = F.when(fulltext.has_term(F.col("text"), "onat"), 1.0).when(fulltext.has_term(F.col("text"), "heit"), 0.7)
    # by way of a generator, so that a text is searched once
    return _docs(spark, sf_dir).select("doc_id", F.explode(F.array(score)).alias("score")).filter("score > 0")


_HIGHLIGHT = "select doc_id, regexp_replace(text, '(?i)\\b(of|the)\\b', '<mark>\\1</mark>', 'g') as marked from documents where regexp_matches(text, '(?i)\\b(of|the)\\b')"


@query(_HIGHLIGHT)
def fts_highlight(spark, sf_dir):
    """Matches marked in whole texts."""
    return _docs(spark, sf_dir).filter(F.col("text").rlike(text.bordered(r"(?i)\b(of|the)\b"))).select("doc_id", fulltext.highlight(F.col("text"), ["the", "of"]).alias("marked"))


@query(_HIGHLIGHT)
def fts_highlight_whole(spark, sf_dir):
    """The same under the name it had while ``fts_highlight`` took heads of texts only."""
    return fts_highlight(spark, sf_dir)


@query(f"with {_WORDS}, t as (select doc_id, len(w) as doc_len, unnest(w) as term from words) select term, count(distinct doc_id) as docs, count(*) as uses from t group by 1 having count(distinct doc_id) >= 20")
def fts_index_terms(spark, sf_dir):
    """Terms of the inverted index that twenty documents have."""
    return fulltext.term_counts(_docs(spark, sf_dir), "text").filter("docs >= 20")


@query("""select a.p_partkey as a, b.p_partkey as b, levenshtein(a.p_name, b.p_name) as distance, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))), 6) as jaccard
 from part a join part b on b.p_partkey = a.p_partkey + 1""")
def text_similarity(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    both = part.join(nxt, "p_partkey")
    j = text.jaccard(F.split("p_name", " "), F.split("other", " "))
    return both.select(F.col("p_partkey").alias("a"), "b", F.levenshtein("p_name", "other").cast("long").alias("distance"), F.round(j, 6).alias("jaccard"))


@query("select a.p_partkey as key, case when length(flat) <= 12 then flat else substr(flat, 1, 9) || '...' end as snippet, substr(sha256(lower(trim(a.p_name))), 1, 16) as text_key from (select *, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) as flat from part) a")
def snippets(spark, sf_dir):
    name = F.col("p_name")
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.snippet(name, 12).alias("snippet"), text.text_key(name).alias("text_key"))


@query("""with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as value from documents)
select doc_id, 'email' as kind, lower(value) as value, count(*) as n from m group by all
union all select doc_id, 'ip', value, count(*) from (select doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b')) as value from documents) group by all
union all select doc_id, 'number', value, count(*) from (select doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{6,}\\b')) as value from documents) group by all""")
def entities(spark, sf_dir):
    return classify.entities(_docs(spark, sf_dir).select("doc_id", "text"))


@query("""with m as (select doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b')) as v from documents),
e as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as v from documents), n as (select doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{6,}\\b')) as v from documents)
select 'ip' as kind, count(*) as uses, count(distinct doc_id) as docs from m union all select 'email', count(*), count(distinct doc_id) from e union all select 'number', count(*), count(distinct doc_id) from n""")
def entity_counts(spark, sf_dir):
    found = classify.entities(_docs(spark, sf_dir).select("doc_id", "text")).groupBy("kind").agg(F.sum("n").alias("uses"), F.countDistinct("doc_id").alias("docs"))
    kinds = spark.createDataFrame([(k,) for k in classify.ENTITIES], "kind string")
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("docs", F.lit(0)).alias("docs"))


@query("""select conv_id, turn, round(least(1.0, 0.3 + case when length(text) > 500 then 0.2 when length(text) > 200 then 0.1 else 0 end + case when contains(text, '`') then 0.2 else 0 end + case when regexp_matches(lower(text), '\\b(decid|chose|should|must|because|was|of the)') then 0.2 else 0 end), 6)::double as relevance from conversations""")
def message_relevance(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(classify.message_relevance(F.col("text")), 6).alias("relevance"))


@query("""select doc_id, (case when regexp_matches(text, '!!') then 1 else 0 end + case when regexp_matches(text, '[#*$%&|<>]{2,}') then 2 else 0 end + case when regexp_matches(text, '\\b[A-Z]{6,}\\b') then 4 else 0 end)::int as flags,
 round(case when regexp_matches(text, '!!') then 0.2 else 0 end + case when regexp_matches(text, '[#*$%&|<>]{2,}') then 0.4 else 0 end + case when regexp_matches(text, '\\b[A-Z]{6,}\\b') then 0.1 else 0 end, 6)::double as risk from documents""")
def redflags(spark, sf_dir):
    return classify.redflags(_docs(spark, sf_dir).select("doc_id", "text"))


@query("""with w as (select doc_id, string_split(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), ' ') as w from documents),
h as (select doc_id, tag, len(list_filter(w, lambda t: list_contains(keys, t))) as hits, len(keys) as n from w, (values ('english', ['the', 'of', 'and', 'is']), ('german', ['der', 'die', 'und', 'ein']), ('french', ['le', 'la', 'et', 'des']), ('spanish', ['el', 'los', 'que', 'en'])) k(tag, keys))
select doc_id, tag, round(least(1.0, hits / greatest(3.0, 0.3 * n)), 6) as confidence from h where hits / greatest(3.0, 0.3 * n) >= 0.6""")
def auto_tags(spark, sf_dir):
    return classify.auto_tags(_docs(spark, sf_dir).select("doc_id", "text"))


_INTENT = """case when regexp_matches(q, '^how (to|do|can)\\b') then 'how_to' when regexp_matches(q, '\\b(error|fail|bug|broken)') then 'debug' when regexp_matches(q, '^(what|where|who|which|show|find)\\b') then 'lookup'
 when regexp_matches(q, '\\b(vs|versus|compare|difference)\\b') then 'compare' when regexp_matches(q, '\\b(config|setup|install|set up)') then 'configure' else 'explore' end"""
_ASK = """qs as (select event_id, case event_id % 6 when 0 then 'How to sort ' when 1 then 'Fix error in ' when 2 then 'Where is ' when 3 then 'Compare cache vs ' when 4 then 'Install ' else 'Ideas about ' end || event_type as text, from events)"""


@query(f"with {_ASK.replace('text, from', 'text from')} select event_id, {_INTENT.replace('q,', 'lower(text),')} as intent from qs")
def intent(spark, sf_dir):
    heads = ["How to sort ", "Fix error in ", "Where is ", "Compare cache vs ", "Install ", "Ideas about "]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = views.table(spark, sf_dir, "events").select("event_id", F.concat(head, F.col("event_type")).alias("text"))
    return rows.select("event_id", classify.intent(F.col("text")).alias("intent"))


@query("""select doc_id, sentence, piece from (select doc_id, unnest(range(1, len(p) + 1))::int as sentence, unnest(p) as piece from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 200) as p from documents))""")
def split_compound(spark, sf_dir):
    return classify.split_sentences(_docs(spark, sf_dir).select("doc_id", "text"), 200)


@query("""select doc_id, least(3, (n_chars > 2000)::int + (n_chars > 8000)::int + (n_chars > 20000)::int)::int as level, (regexp_matches(lower(text), '\\b(the|of)\\b'))::int as english from documents""")
def complexity(spark, sf_dir):
    n = F.col("n_chars")
    level = sum(((n > k).cast("int") for k in (2000, 8000, 20000)), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", level.alias("level"), F.lower("text").rlike(text.bordered(r"\b(the|of)\b")).cast("int").alias("english"))


_SYNONYMS = {"red": ("crimson", "scarlet", "ruby"), "small": ("little", "tiny"), "plate": ("dish",), "widget": ("gadget", "device"), "hot": ("warm", "heated")}
_SYNONYM_ROWS = [(w, k, len(v), x) for w, v in _SYNONYMS.items() for k, x in enumerate(v)]


@query(f"""with s(word, place, n, synonym) as (values {', '.join(map(str, _SYNONYM_ROWS))}), w as (select p_partkey as id, string_split(lower(p_name), ' ') as w from part),
t as (select id, w, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from w),
x as (select id, pos, place, list_transform(w, lambda y, k: case when k = pos then synonym else y end) as e, 0.8 - place / n * 0.2 as c, row_number() over (partition by id order by pos, place) as r from t join s using (word))
select id, array_to_string(e, ' ') as expanded, round(c, 6)::double as confidence from x where r <= 3""")
def expand_queries(spark, sf_dir):
    """Part names as queries, with words replaced by their synonyms."""
    synonyms = spark.createDataFrame(_SYNONYM_ROWS, "word string, place int, of int, synonym string")
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return fulltext.expand(parts, synonyms)


@query()
def fts_stemmed_topk(spark, sf_dir):
    """The best matches of stems, by BM25 over stemmed words; tests compare with the rule in plain Python."""
    from ..functions.stem import stem

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    found = fulltext.stemmed_bm25(docs, "text", [stem(t) for t in ("hating", "onions", "tied")])
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)
