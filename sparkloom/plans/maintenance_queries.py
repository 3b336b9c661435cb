"""Queries of upkeep and learning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, maintenance, policies, vector
from ..operators.stats import when_count
from ..registry import query
from ..sources import views
from ..sources.views import sql

_PAIRS = "pairs as (select x.vec_id as a, y.vec_id as b, round(list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))), 6) as similarity from vectors x join vectors y on x.vec_id < y.vec_id)"


def _pairs(spark, sf_dir, threshold):
    return vector.similar_pairs(views.vectors(spark, sf_dir), threshold)


@query()
def similarity_groups(spark, sf_dir):
    """Greedy groups of similar vectors; tests compare with the sequential rule."""
    return maintenance.vector_groups(views.vectors(spark, sf_dir), 0.3)


@query()
def consolidate_dedupe(spark, sf_dir):
    """What becomes of each entry when groups of similar entries are merged into their primary; checked by tests."""
    groups = maintenance.vector_groups(views.vectors(spark, sf_dir), 0.3)
    merged = groups.select(F.col("member").alias("entry_id"), F.col("primary").alias("into"))
    rows = views.entries(spark, sf_dir).select("entry_id", "is_active").join(merged, "entry_id", "left")
    return rows.select("entry_id", (F.col("is_active") & F.col("into").isNull()).alias("is_active"), "into")


@query(sql(f"""+{_PAIRS}, near as (select * from pairs where similarity >= 0.3), n as (select entry_id, count(*) as n from retrievals group by 1),
j as (select near.*, coalesce(x.n, 0) as ra, coalesce(y.n, 0) as rb from near left join n x on x.entry_id = a left join n y on y.entry_id = b),
d as (select *, not (ra >= 5 and rb >= 5) and ((least(ra, rb) = 0 and greatest(ra, rb) >= 5) or (least(ra, rb) > 0 and greatest(ra, rb) >= 3.0 * least(ra, rb))) as duplicate from j)
select a, b, similarity, ra, rb, duplicate, case when duplicate then case when ra > rb then a else b end end as dominant from d""", "vectors", "feedback"))
def duplicate_refinement(spark, sf_dir):
    counts = views.feedback(spark, sf_dir)[0].groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
    return maintenance.refine_duplicates(_pairs(spark, sf_dir, 0.3), counts)


@query(sql(f"""+{_PAIRS}, near as (select * from pairs where similarity >= 0.35), ends as (select a, b from near union select b, a from near),
r as (select a as node, a as other from ends union select node, b from r join ends on other = a), lab as (select node, min(other) as root from r group by node),
o as (select entry_id, (access_count >= 12)::int as success from entries),
m as (select root, count(*) as members, avg(coalesce(success, 0)) as success from lab left join o on entry_id = node group by root),
s as (select root, avg(similarity) as similarity from near join lab on node = a group by root)
select root, members, round(similarity, 6) as similarity, round(success, 6) as success, round(least(1.0, members / 5.0) * 0.3 + similarity * 0.5 + success * 0.2, 6) as confidence from m join s using (root) where members >= 3""", "vectors", "entries"))
def pattern_groups(spark, sf_dir):
    """Groups of linked vectors as experience patterns, with their confidence."""
    outcomes = views.entries(spark, sf_dir).select("entry_id", (F.col("access_count") >= 12).cast("int").alias("success"))
    found = maintenance.linked_groups(vector.similar_links(views.vectors(spark, sf_dir), 0.35), outcomes)
    confidence = policies.pattern_confidence(F.col("members"), F.col("similarity"), F.col("similarity"), F.col("success"))
    return found.select("root", "members", F.round("similarity", 6).alias("similarity"), F.round("success", 6).alias("success"), F.round(confidence, 6).alias("confidence"))


@query(sql("select entry_id, born_h from entries where born_h > 700", "entries"))
def collect_since(spark, sf_dir):
    """Entries born after hour 700: one step of an incremental collector."""
    return maintenance.collect_since(views.entries(spark, sf_dir).select("entry_id", "born_h"), "born_h", 700)[0]


_KEY = "sha256(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')))"


@query(sql(f"""select conv_id, turn from conversations where role = 'assistant' and length(text) >= 60 and {_KEY.format(c='text')} not in (select {_KEY.format(c='content')} from entries where content is not null)""", "entries"))
def missed_extractions(spark, sf_dir):
    """Longer assistant messages that no entry has."""
    turns = views.table(spark, sf_dir, "conversations")
    return maintenance.missed(turns, views.entries(spark, sf_dir).filter("content is not null"), (F.col("role") == "assistant") & (F.length("text") >= 60))


_RULES = (("no_links", "https?://", True), ("no_tables", r"\|.*\|.*\|", False), ("no_shouting", "!!!|[A-Z]{12}", True))


@query("select id, rule, blocking from (select doc_id as id, text from documents), (values ('no_links', 'https?://', true), ('no_tables', '\\|.*\\|.*\\|', false), ('no_shouting', '!!!|[A-Z]{12}', true)) r(rule, pattern, blocking) where regexp_matches(text, pattern)")
def rule_violations(spark, sf_dir):
    return maintenance.rule_hits(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), list(_RULES))


@query("""with s as (select user_id, event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c, lead(event_type <> 'error', 2) over w as ok from events window w as (partition by user_id order by ts, event_id))
select a, b, c, count(*) as n, round(avg(ok::int), 6) as success from s where c is not null group by a, b, c""")
def tool_trigrams(spark, sf_dir):
    """Three steps in a row, how often and with what end."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("a"), F.lead("event_type", 1).over(order).alias("b"), F.lead("event_type", 2).over(order).alias("c")
    )
    return steps.filter("c is not null").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("c") != "error").cast("int")), 6).alias("success"))


@query(sql("""+f as (select entry_id, t.template, replace(replace(t.ask, '{title}', coalesce(title, '')), '{category}', coalesce(category, '')) as instruction, content as output from entries,
 (values (0, 'What is known about {title}?'), (1, 'Give the {category} entry named {title}.')) t(template, ask) where is_active and entry_type in ('guideline', 'knowledge') and content is not null)
select entry_id, template, instruction, md5(output) as output_md5 from f""", "entries"))
def lora_examples(spark, sf_dir):
    """Two instruction templates for each active rule or fact."""
    asks = ("What is known about {title}?", "Give the {category} entry named {title}.")
    fill = lambda ask: F.replace(F.replace(F.lit(ask), F.lit("{title}"), F.coalesce("title", F.lit(""))), F.lit("{category}"), F.coalesce("category", F.lit("")))
    rows = views.entries(spark, sf_dir).filter("is_active and entry_type in ('guideline', 'knowledge') and content is not null")
    return rows.select("entry_id", F.posexplode(F.array(*map(fill, asks))).alias("template", "instruction"), F.md5("content").alias("output_md5"))


@query(sql("select entry_id, arg_max(vec_id, version) as vec_id, max(version) as version from (select vec_id % 97 as entry_id, vec_id // 97 as version, vec_id from vectors) group by 1", "vectors"))
def newest_vectors(spark, sf_dir):
    """The newest version's vector of each entry, by one combined maximum."""
    rows = views.vectors(spark, sf_dir).select((F.col("vec_id") % 97).alias("entry_id"), F.expr("vec_id div 97").alias("version"), "vec_id")
    return rows.groupBy("entry_id").agg(F.max_by("vec_id", "version").alias("vec_id"), F.max("version").alias("version"))


@query(sql("""+t as (select distinct entry_type as tag from entries union select tag from entry_tags), s as (select distinct tag from entry_tags)
select tag, tag in (select tag from s) as existed from t""", "entries", "entry_tags"))
def seed_tags(spark, sf_dir):
    """Tags after seeding: those that were there, and the predefined ones (the entry types) that were not."""
    have = views.entry_tags(spark, sf_dir).select("tag").distinct()
    seeds = views.entries(spark, sf_dir).select(F.col("entry_type").alias("tag")).distinct()
    return have.withColumn("existed", F.lit(True)).unionByName(seeds.join(have, "tag", "left_anti").withColumn("existed", F.lit(False)))


@query(sql("select count(*) as vectors, count(distinct entry_type) as types, count(distinct e.entry_id) as entries from vectors v left join (select entry_id from entries where is_active) e on e.entry_id = v.vec_id", "vectors", "entries"))
def backfill_stats(spark, sf_dir):
    live = views.entries(spark, sf_dir).filter("is_active").select("entry_id")
    rows = views.vectors(spark, sf_dir).select("vec_id", "entry_type").join(live, F.col("vec_id") == F.col("entry_id"), "left")
    return rows.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("entry_type").alias("types"), F.countDistinct("entry_id").alias("entries"))


@query(sql("""+old as (select source_id, target_id from relations where relation_type in ('depends_on', 'related_to'))
select distinct source_id, target_id from relations r where not exists (select 1 from old o where o.source_id = r.source_id and o.target_id = r.target_id)""", "relations"))
def graph_backfill(spark, sf_dir):
    """Edges that the typed graph lacks."""
    edges = views.relations(spark, sf_dir)
    old = edges.filter(F.col("relation_type").isin("depends_on", "related_to")).select("source_id", "target_id")
    return edges.select("source_id", "target_id").distinct().join(old, ["source_id", "target_id"], "left_anti")


@query(sql("""+direct as (select target_id as node from relations where source_id = 6 and relation_type in ('depends_on', 'parent_task')), after_ as (select r.target_id as node from relations r join direct d on r.source_id = d.node where relation_type in ('depends_on', 'parent_task'))
select node from direct union select node from after_""", "relations"))
def blocked_tasks(spark, sf_dir):
    """Tasks that one task blocks, directly or over one other, each once."""
    edges = views.relations(spark, sf_dir).filter(F.col("relation_type").isin("depends_on", "parent_task")).select("source_id", "target_id")
    direct = edges.filter("source_id = 6").select(F.col("target_id").alias("node"))
    after = edges.join(direct, F.col("source_id") == F.col("node")).select(F.col("target_id").alias("node"))
    return direct.unionByName(after).distinct()


@query(sql("""+ks as (select regexp_replace(title, '[^ -~]', '?', 'g') as title from entries where title is not null and title <> '' group by 1)
select least(x.title, y.title) as x, greatest(x.title, y.title) as y, round(1 - levenshtein(lower(x.title), lower(y.title)) / greatest(length(x.title), length(y.title)), 6) as similarity from ks x join ks y on x.title < y.title
 where abs(length(x.title) - length(y.title)) <= 8 and round(1 - levenshtein(lower(x.title), lower(y.title)) / greatest(length(x.title), length(y.title)), 6) >= 0.8""", "entries"))
def close_titles(spark, sf_dir):
    """Different titles that are nearly the same, by shared segments. Characters beyond ASCII count as ``?``, since SQL would count their bytes."""
    names = views.entries(spark, sf_dir).filter("title is not null and title <> ''").select(F.regexp_replace("title", "[^ -~]", "?").alias("name")).distinct()
    return maintenance.close_names(names, 0.8)


@query("""with n as (select p_name as name, count(*) as parts from part group by 1)
select x.name as na, y.name as nb, x.parts as parts_a, y.parts as parts_b, round(1 - levenshtein(lower(x.name), lower(y.name)) / greatest(length(x.name), length(y.name)), 6) as similarity
 from n x join n y on x.name < y.name where round(1 - levenshtein(lower(x.name), lower(y.name)) / greatest(length(x.name), length(y.name)), 6) >= 0.6""")
def name_duplicates(spark, sf_dir):
    """Pairs of close part names, with how many parts have each: copies aren't spelled out into pairs."""
    names = views.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("parts"))
    near = maintenance.close_names(names.select("name"), 0.6)
    side = lambda c, n: names.select(F.col("name").alias(c), F.col("parts").alias(n))
    return near.join(side("x", "parts_a"), "x").join(side("y", "parts_b"), "y").select(F.col("x").alias("na"), F.col("y").alias("nb"), "parts_a", "parts_b", "similarity")


@query(sql("""+t as (select user_id, unnest(regexp_extract_all(lower(text), '\\b(always|never)\\s+([a-z]+)', 1)) as kind, unnest(regexp_extract_all(lower(text), '\\b(always|never)\\s+([a-z]+)', 2)) as subject from messages)
select user_id, subject, count(*) filter (where kind = 'always') as pro, count(*) filter (where kind = 'never') as contra from t group by user_id, subject having count(distinct kind) = 2""", "messages"))
def contradictions(spark, sf_dir):
    """Subjects that one user both always and never wants: statements grouped by subject."""
    low, pattern = F.lower("text"), text.bordered(r"\b(always|never)\s+([a-z]+)")
    both = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("subject"))
    rows = views.messages(spark, sf_dir).select("user_id", F.explode(both).alias("s")).select("user_id", "s.kind", "s.subject")
    by = rows.groupBy("user_id", "subject").agg(when_count(F.col("kind") == "always").alias("pro"), when_count(F.col("kind") == "never").alias("contra"))
    return by.filter("pro > 0 and contra > 0")


@query(sql("select entry_id, entry_type, title from entries where entry_type = 'knowledge' and is_active and entry_id in (select entry_id from validity where (from_h is null or from_h <= 400) and (until_h is null or until_h > 400))", "entries", "validity"))
def temporal_scan(spark, sf_dir):
    """Knowledge that is valid at hour 400, with its head."""
    from ..operators import filters

    valid = views.validity(spark, sf_dir).filter(filters.valid_at(400, F.col("from_h"), F.col("until_h"))).select("entry_id")
    return views.entries(spark, sf_dir).filter("entry_type = 'knowledge' and is_active").join(valid, "entry_id", "left_semi").select("entry_id", "entry_type", "title")


@query(sql("""+sem as (select vec_id as entry_id from vectors where label = 3), fts as (select entry_id from entries where lower(title) like '%the%')
select entry_id, entry_id in (select entry_id from sem) as semantic, entry_id in (select entry_id from fts) as full_text from entries where is_active and (entry_id in (select entry_id from sem) or entry_id in (select entry_id from fts))""", "entries", "vectors"))
def candidate_union(spark, sf_dir):
    """Candidates of either search, each once, with where they came from."""
    sem = views.vectors(spark, sf_dir).filter("label = 3").select(F.col("vec_id").alias("entry_id"), F.lit(True).alias("s"))
    fts = views.entries(spark, sf_dir).filter(text.contains(F.col("title"), "the")).select("entry_id", F.lit(True).alias("f"))
    both = sem.join(fts, "entry_id", "full").select("entry_id", F.coalesce("s", F.lit(False)).alias("semantic"), F.coalesce("f", F.lit(False)).alias("full_text"))
    return both.join(views.entries(spark, sf_dir).filter("is_active").select("entry_id"), "entry_id", "left_semi")


@query()
def hierarchy(spark, sf_dir):
    """Summary levels: communities of similar vectors, then communities of their centroids; checked by tests."""
    return vector.hierarchy(views.vectors(spark, sf_dir), levels=2, threshold=0.3)
