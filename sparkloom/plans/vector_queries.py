"""Queries of vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, lsh_join, vector
from ..registry import query
from ..sources import views
from ..sources.views import sql

_COS = "list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))"


def _query_vector(spark, sf_dir) -> list[float]:
    """One row: the vector with id 0."""
    return views.vectors(spark, sf_dir).filter("vec_id = 0").first()["v"]


@query(sql(f"+one as (select v as q from vectors where vec_id = 0) select vec_id, entry_type, round(least(1.0, greatest(0.0, {_COS})), 6) as similarity from vectors, one order by similarity desc, vec_id limit 60", "vectors"))
def knn_topk(spark, sf_dir):
    return vector.knn(views.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 60).select("vec_id", "entry_type", "similarity")


@query(sql(f"+one as (select v as q from vectors where vec_id = 0) select vec_id, entry_type, round(least(1.0, greatest(0.0, {_COS})), 6) as similarity from vectors, one where entry_type = 'guideline' and vec_id <> 0 and round({_COS}, 6) >= 0.1 order by similarity desc, vec_id limit 25", "vectors"))
def knn_by_type(spark, sf_dir):
    rows = views.vectors(spark, sf_dir).filter("entry_type = 'guideline' and vec_id <> 0")
    return vector.knn(rows, _query_vector(spark, sf_dir), 25, 0.1).select("vec_id", "entry_type", "similarity")


@query(sql(f"+one as (select v as q from vectors where vec_id = 0), s as (select vec_id, {_COS} as c, list_distance(v, q) as d, list_inner_product(v, q) as p from vectors, one) select vec_id, round(1 - (1 - c) / 2, 6) as half_cosine, round(1 / (1 + d), 6) as l2, round((1 - p) / 2, 6) as dot_form, round(least(1.0, greatest(0.0, c)), 6) as cosine from s", "vectors"))
def distance_forms(spark, sf_dir):
    q = vector.literal(_query_vector(spark, sf_dir))
    v = F.col("v")
    c, p = vector.cosine(v, q), vector.dot(v, q)
    d = F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    return views.vectors(spark, sf_dir).select(
        "vec_id", F.round(1 - (1 - c) / 2, 6).alias("half_cosine"), F.round(1 / (1 + d), 6).alias("l2"),
        F.round((1 - p) / 2, 6).alias("dot_form"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6).alias("cosine"),
    )


_PAIRS = "pairs as (select x.vec_id as a, y.vec_id as b, round(list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))), 6) as similarity from vectors x join vectors y on x.vec_id < y.vec_id)"


@query(sql(f"+{_PAIRS} select * from pairs where similarity >= 0.3", "vectors"))
def similar_pairs(spark, sf_dir):
    return vector.similar_pairs(views.vectors(spark, sf_dir), 0.3)


@query()
def lsh_pairs(spark, sf_dir):
    """Texts that share most pairs of words, each with its hundred nearest at most: hyperplane buckets with probes; tests measure recall against all pairs."""
    return lsh_join.lsh_pairs(views.text_vectors(spark, sf_dir), 0.8)


@query()
def similar_text_classes(spark, sf_dir):
    """The same exactly, without a bound on partners, by metric regions: pairs between classes of equal vectors, and each member with its class at 1.0."""
    pairs, members = vector.similar_classes(views.text_vectors(spark, sf_dir), 0.8)
    copies = members.filter("cls <> vec_id").select(F.col("cls").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies)


@query(sql("select label, place - 1 as place, round(avg(x), 6) as value from (select label, unnest(v) as x, generate_subscripts(v, 1) as place from vectors) group by all", "vectors"))
def centroids(spark, sf_dir):
    return vector.centroids(views.vectors(spark, sf_dir), "label").select("label", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query(sql(f"+{_PAIRS}, l as (select p.similarity, x.label from pairs p join vectors x on x.vec_id = a join vectors y on y.vec_id = b and x.label = y.label) select label, count(*) as pairs, round(avg(similarity), 6) as mean, least(1.0, min(similarity)) as low, greatest(0.0, max(similarity)) as high from l group by 1", "vectors"))
def cohesion(spark, sf_dir):
    """Pairwise similarity inside each label."""
    found = vector.cohesion(views.vectors(spark, sf_dir), "label")
    return found.select("label", "pairs", F.round("mean", 6).alias("mean"), F.least(F.lit(1.0), "low").alias("low"), F.greatest(F.lit(0.0), "high").alias("high"))


_CODES = "list_transform(v, lambda x: floor((least(1.0, greatest(-1.0, x)) + 1.0) / 2.0 * 255 + 0.5))"


@query(sql(f"+e as (select vec_id, unnest(v) as x, unnest(list_transform({_CODES}, lambda c: -1.0 + c / 255 * 2.0)) as y from vectors) select vec_id, round(avg((x - y) * (x - y)), 9) as mse, round(max(abs(x - y)), 6) as worst, round(avg(abs(x - y)), 6) as mean from e group by 1", "vectors"))
def quantize_error(spark, sf_dir):
    v = F.col("v")
    back = vector.dequantise(vector.quantise(v, -1.0, 1.0), -1.0, 1.0)
    gaps = views.vectors(spark, sf_dir).select("vec_id", F.zip_with(v, back, lambda x, y: x - y).alias("g"))
    mean = lambda f: F.aggregate(F.transform("g", f), F.lit(0.0), lambda acc, x: acc + x) / F.size("g")
    return gaps.select(
        "vec_id", F.round(mean(lambda g: g * g), 9).alias("mse"), F.round(F.array_max(F.transform("g", F.abs)), 6).alias("worst"), F.round(mean(F.abs), 6).alias("mean")
    )


@query()
def sparse_projection(spark, sf_dir):
    """Sixteen of sixty-four dimensions; tests check that distances are kept on average."""
    rows = vector.sparse_projection(64, 16)
    return views.vectors(spark, sf_dir).select("vec_id", vector.project(F.col("v"), rows).alias("reduced")).select("vec_id", F.posexplode("reduced").alias("place", "x")).select("vec_id", "place", F.round("x", 6).alias("x"))


@query(sql(f"""+one as (select v as q from vectors where vec_id = 0), s as (select vec_id, (vec_id * 13 % 50)::double as base, {_COS} as c from vectors, one),
r as (select *, row_number() over (order by base desc, vec_id) as place from s)
select vec_id, case when place <= 20 then 0 else 1 end as part, round(case when place <= 20 then 0.5 * c + 0.5 * base else base end, 6) as score from r where place <= 60""", "vectors"))
def rerank_blend(spark, sf_dir):
    """The first twenty get the blend of similarity and score; the tail keeps its order."""
    q = vector.literal(_query_vector(spark, sf_dir))
    scored = views.vectors(spark, sf_dir).select("vec_id", (F.col("vec_id") * 13 % 50).cast("double").alias("base"), vector.cosine(F.col("v"), q).alias("c"))
    order = [F.desc("base"), F.col("vec_id")]
    head = scored.orderBy(*order).limit(20)
    tail = scored.orderBy(*order).limit(60).offset(20)
    return head.select("vec_id", F.lit(0).alias("part"), F.round(0.5 * F.col("c") + 0.5 * F.col("base"), 6).alias("score")).unionByName(tail.select("vec_id", F.lit(1).alias("part"), F.round("base", 6).alias("score")))


@query(sql(f"""+qs as (select v as q, w from vectors, (values (0::bigint, 1.0), (1, 0.8), (2, 0.6)) k(id, w) where vec_id = id)
select vec_id, round(max(greatest(0.0, {_COS}) * w), 6) as score from vectors, qs group by 1 order by score desc, vec_id limit 40""", "vectors"))
def multi_query_max(spark, sf_dir):
    """Several weighted query vectors (at most a handful); an entry's score is its best."""
    rows = views.vectors(spark, sf_dir)
    weights = {0: 1.0, 1: 0.8, 2: 0.6}
    queries = {r["vec_id"]: r["v"] for r in rows.filter(F.col("vec_id").isin(list(weights))).collect()}
    hits = [F.greatest(F.lit(0.0), vector.cosine(F.col("v"), vector.literal(queries[i]))) * w for i, w in weights.items() if i in queries]
    return rows.select("vec_id", F.round(F.greatest(*hits), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(40)


@query(sql(f"""+one as (select v as q from vectors where vec_id = 0), s as (select e.entry_id, {_COS} as sim, case when lower(e.title) like '%the%' then 0.5 end as fts, e.priority, e.entry_type, e.born_h from vectors join entries e on e.entry_id = vec_id, one where e.is_active)
select entry_id, round(coalesce(40.0 * (0.7 * sim + 0.3 * coalesce(fts, 0.0)), 0.0) + case when fts is not null then 30.0 else 0.0 end + case when entry_type = 'guideline' then priority * 0.2 else 0.0 end + exp(-ln(2.0) * ((744 - born_h) / 24.0) / 30.0) * 10.0, 6) as score
from s order by score desc, entry_id limit 50""", "vectors", "entries"))
def hybrid_search(spark, sf_dir):
    from ..functions import scoring, text

    q = vector.literal(_query_vector(spark, sf_dir))
    rows = views.vectors(spark, sf_dir).select(F.col("vec_id").alias("entry_id"), "v").join(views.entries(spark, sf_dir).filter("is_active"), "entry_id")
    fts = F.when(text.contains(F.col("title"), "the"), 0.5)
    age = (F.lit(views.AS_OF_HOURS) - F.col("born_h")) / 24.0
    score = (
        scoring.semantic_term(vector.cosine(F.col("v"), q), fts) + F.when(fts.isNotNull(), 30.0).otherwise(0.0)
        + F.when(F.col("entry_type") == "guideline", F.col("priority") * 0.2).otherwise(0.0) + scoring.recency(age)
    )
    return rows.select("entry_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "entry_id").limit(50)


@query()
def inferred_edges(spark, sf_dir):
    """Similar pairs from the best down, at most five per entry; tests compare with the sequential rule."""
    return vector.nearest_edges(views.vectors(spark, sf_dir), 0.3)


@query(sql(f"""+one as (select v as q from vectors where vec_id = 0), cents as (select label, list(value order by place) as v from (select label, place, avg(x) as value from (select label, unnest(v) as x, generate_subscripts(v, 1) as place from vectors) group by all) group by label),
near as (select label from (select label, {_COS} as c from cents, one) order by round(c, 6) desc, label limit 3)
select vec_id, label, round({_COS}, 6) as similarity from vectors join near using (label), one order by similarity desc, vec_id limit 30""", "vectors"))
def coarse_to_fine(spark, sf_dir):
    """Group centroids first, then the members of the three nearest groups."""
    q = vector.literal(_query_vector(spark, sf_dir))
    rows = views.vectors(spark, sf_dir)
    parts = vector.centroids(rows, "label").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("v"))
    near = parts.select("label", F.round(vector.cosine(F.col("v"), q), 6).alias("c")).orderBy(F.desc("c"), "label").limit(3).select("label")
    members = rows.join(near, "label", "left_semi").select("vec_id", "label", F.round(vector.cosine(F.col("v"), q), 6).alias("similarity"))
    return members.orderBy(F.desc("similarity"), "vec_id").limit(30)
