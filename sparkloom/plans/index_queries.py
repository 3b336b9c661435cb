"""Queries of indexes that are kept: vectors in cells, words in segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_index, vector_index
from ..operators.graph import cut
from ..registry import query
from ..shared import new_path
from ..sources import views
from ..sources.views import sql

_COS = "list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v)))"
_ASKED = """+s as (select y.vec_id as query_id, x.vec_id, round({cos}, 6) as similarity from vectors x, vectors y where y.vec_id % 100 = 0{where}),
r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, similarity from r where rank <= 10"""


def _asked(rows):
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


@query()
def vector_index_search(spark, sf_dir):
    """The ten nearest of every hundredth text among all texts, by inverted lists with product codes. Tests measure recall against brute force."""
    rows = cut(views.text_vectors(spark, sf_dir), "text-vectors")
    return vector_index.search(spark, vector_index.build(rows), _asked(rows))


@query(sql(_ASKED.format(cos=_COS, where=""), "vectors"))
def vector_index_exact(spark, sf_dir):
    """The exact ten nearest of every hundredth vector: cells that can't hold a nearer one are left out by their radius."""
    rows = views.vectors(spark, sf_dir)
    return vector_index.exact_search(spark, vector_index.build(rows), _asked(rows))


_STATE = """state as (select doc_id, substr(text, 1, 40) as title, case when doc_id % 10 = 3 then text || ' onat sandbox onat' else text end as content from documents where doc_id is not null and doc_id % 17 <> 0)"""
_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9à-öø-ÿ]+'), lambda t: length(t) > 0)"
_INDEXED = f"""with {_STATE}, words as (select doc_id, {_SPLIT.format('title')} as a, {_SPLIT.format('content')} as b from state),
st as (select count(*)::double as n, avg(len(a) + len(b)) as mean from words),
hits as (select doc_id, len(a) + len(b) as doc_len, unnest(list_concat(list_transform(a, lambda t: {{'t': t, 'w': 2.0}}), list_transform(b, lambda t: {{'t': t, 'w': 1.0}}))) as x from words),
terms(k, term, prefix) as (values (0, 'onat', false), (1, 'heit', false), (2, 'sandb', true)),
tf as (select doc_id, doc_len, k, sum(x.w) as tf from hits join terms on x.t = term or (prefix and starts_with(x.t, term)) group by all), df as (select k, count(*) as df from tf group by 1)
select doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean))), 6)::double as score
from tf join df using (k), st group by 1"""
_WANTED = [("onat", False), ("heit", False), ("sandb", True)]


def updated_index(spark, sf_dir):
    """All documents, then a stream of two files of changes: a tenth gets new words, and those that are inactive are deleted."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"))
    index = text_index.commit(docs, text_index.create(spark, ("title", "content")))
    folder = new_path(spark, "changes")
    changed = docs.filter("doc_id % 10 = 3 and doc_id % 17 <> 0").select("doc_id", "title", F.concat("content", F.lit(" onat sandbox onat")).alias("content"), F.lit(False).alias("deleted"))
    changed.write.parquet(f"{folder}/part=1")
    docs.filter("doc_id % 17 = 0").withColumn("deleted", F.lit(True)).write.parquet(f"{folder}/part=2")
    stream = spark.readStream.schema(changed.schema).parquet(f"{folder}/*")
    return text_index.follow(stream, index.path, "changes", new_path(spark, "checkpoint"))


@query(_INDEXED)
def text_index_search(spark, sf_dir):
    """Every match of three terms after changes, by a kept index that is updated in place; title words count twice."""
    found = text_index.search(spark, updated_index(spark, sf_dir), _WANTED, {"title": 2.0})
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""with {_STATE}, t as (select doc_id, unnest(list_distinct({_SPLIT.format('content')})) as term from state)
select term, count(*) as docs from t where starts_with(term, 'tho') or starts_with(term, 'sandb') or term = 'heit' group by 1""")
def text_index_terms(spark, sf_dir):
    """The index's own terms by prefix, with how many live documents have each: three buckets of the postings."""
    wanted = [("tho", True), ("sandb", True), ("heit", False)]
    found = text_index.matches(spark, updated_index(spark, sf_dir), wanted, ("content",))
    return found.groupBy("term").agg(F.countDistinct("doc_id").alias("docs"))
