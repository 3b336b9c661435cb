"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, graph_parts, near_links
from ..registry import query
from ..sources import views
from ..sources.views import sql

_STARTS = (1, 7, 20)


def _starts(spark):
    return spark.createDataFrame([(s,) for s in _STARTS], "node long")


def _reach_sql(edges: str, depth: int) -> str:
    levels = ["l0 as (select * from (values (1::bigint, 1::bigint), (7, 7), (20, 20)) v(start, node))", f"e as (select distinct a, b from ({edges}))"]
    for k in range(1, depth + 1):
        levels.append(f"l{k} as (select distinct start, b as node from l{k - 1} join e on node = a)")
    every = " union all ".join(f"select start, node, {k} as depth from l{k}" for k in range(1, depth + 1))
    return sql("+" + ", ".join(levels) + f" select start, node, min(depth)::int as depth from ({every}) where node <> start group by start, node", "relations")


_FWD, _BACK = "select source_id as a, target_id as b from relations", "select target_id as a, source_id as b from relations"


@query(_reach_sql(_FWD, 3))
def reach_forward(spark, sf_dir):
    return graph.reachable(_starts(spark), views.relations(spark, sf_dir), 3, "forward")


@query(_reach_sql(_BACK, 2))
def reach_backward(spark, sf_dir):
    return graph.reachable(_starts(spark), views.relations(spark, sf_dir), 2, "backward")


@query(_reach_sql(f"{_FWD} union all {_BACK}", 2))
def reach_both(spark, sf_dir):
    return graph.reachable(_starts(spark), views.relations(spark, sf_dir), 2)


@query(_reach_sql("select source_id as a, target_id as b from relations where relation_type in ('depends_on', 'related_to')", 4))
def reach_filtered(spark, sf_dir):
    edges = views.relations(spark, sf_dir).filter(F.col("relation_type").isin("depends_on", "related_to"))
    return graph.reachable(_starts(spark), edges, 4, "forward")


@query(sql("select target_id as node, relation_type, 'out' as side from relations where source_id = 7 union all select source_id, relation_type, 'in' from relations where target_id = 7", "relations"))
def neighbors(spark, sf_dir):
    edges = views.relations(spark, sf_dir)
    out = edges.filter("source_id = 7").select(F.col("target_id").alias("node"), "relation_type", F.lit("out").alias("side"))
    return out.unionByName(edges.filter("target_id = 7").select(F.col("source_id").alias("node"), "relation_type", F.lit("in").alias("side")))


@query(sql("""+p as (select [source_id, target_id] as path, target_id as last, 1 as steps from relations where source_id = 1 and target_id <> 1
 union select list_append(path, target_id), target_id, steps + 1 from p join (select distinct source_id, target_id from relations) e on source_id = last where steps < 5 and last <> 47 and not list_contains(path, target_id))
select array_to_string(path, '>') as path, steps::int as steps from p where last = 47""", "relations"))
def simple_paths(spark, sf_dir):
    found = graph.simple_paths(1, 47, views.relations(spark, sf_dir), 5)
    return found.select(F.array_join("path", ">").alias("path"), "steps")


@query(sql("""+e as (select distinct source_id as a, target_id as b from relations where relation_type = 'depends_on' and source_id <> target_id),
ends as (select a, b from e union select b, a from e),
r as (select a as node, a as other from ends union select node, b from r join ends on other = a)
select node, min(other) as root from r group by node""", "relations"))
def components(spark, sf_dir):
    """Components of the dependency edges."""
    return graph.components(views.relations(spark, sf_dir).filter("relation_type = 'depends_on'"))


_PARENT = "parents as (select doc_id as node, case when doc_id >= 4 then doc_id // 4 end as parent from documents)"


@query(f"with recursive {_PARENT}, up as (select node, parent as ancestor, 1 as depth from parents where parent is not null union all select up.node, p.parent, depth + 1 from up join parents p on p.node = up.ancestor where p.parent is not null) select * from up")
def ancestors(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").selectExpr("doc_id as node", "case when doc_id >= 4 then doc_id div 4 end as parent")
    return graph.ancestors(rows)


@query(f"with {_PARENT} select parent, count(*) as children, min(node) as first_child from parents where parent is not null group by parent")
def children(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").selectExpr("doc_id as node", "case when doc_id >= 4 then doc_id div 4 end as parent").filter("parent is not null")
    return rows.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.min("node").alias("first_child"))


@query(sql("""+blk as (select source_id as a, target_id as b from relations where relation_type in ('depends_on', 'related_to', 'applies_to')),
r as (select a as start, b as node, 1 as d from blk union select start, b, d + 1 from r join blk on node = a where d < 4)
select distinct start as node from r where node = start""", "relations"))
def blocker_cycles(spark, sf_dir):
    """Nodes that block themselves within four steps."""
    edges = views.relations(spark, sf_dir).filter("relation_type in ('depends_on', 'related_to', 'applies_to')")
    loops = edges.filter("source_id = target_id").select(F.col("source_id").alias("node"))
    step = graph.cut(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct())
    walk, found = step, loops
    for _ in range(3):
        nxt = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
        walk = graph.cut(walk.join(nxt, "b").select("a", F.col("c").alias("b")).distinct())
        found = found.unionByName(walk.filter("a = b").select(F.col("a").alias("node")))
    return found.distinct()


@query(sql("""+blk as (select distinct source_id as a, target_id as b from relations where relation_type in ('depends_on', 'related_to')),
r as (select a as start, b as node from blk union select start, b from r join blk on node = a)
select distinct start as node from r where node = start""", "relations"))
def cycle_nodes(spark, sf_dir):
    """Nodes that block themselves over any number of steps."""
    return graph_parts.on_cycles(views.relations(spark, sf_dir).filter("relation_type in ('depends_on', 'related_to')"))


@query(sql("""select relation_type, count(*) as n, count(distinct source_id) as sources, count(distinct target_id) as targets from relations group by 1""", "relations"))
def relation_stats(spark, sf_dir):
    by = views.relations(spark, sf_dir).groupBy("relation_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query(sql("""select entry_id, entry_type from entries where entry_id in (select target_id from relations where source_id = 7 union select source_id from relations where target_id = 7) and is_active""", "entries", "relations"))
def related_entries(spark, sf_dir):
    """The relation filter: a semi-join with the nodes one step from the start."""
    near = graph.reachable(spark.createDataFrame([(7,)], "node long"), views.relations(spark, sf_dir), 1).select(F.col("node").alias("entry_id"))
    return views.entries(spark, sf_dir).filter("is_active").join(near, "entry_id", "left_semi").select("entry_id", "entry_type")


@query()
def communities(spark, sf_dir):
    """Label propagation over similar vectors; checked by tests (labels are stable, modularity is positive on planted groups)."""
    return graph.voted(near_links.near_links(views.vectors(spark, sf_dir), 0.3))


@query()
def communities_modularity(spark, sf_dir):
    """Communities of similar vectors of three nodes or more, by modularity moves, each with its size; tests check planted groups."""
    labels = graph_parts.near_communities(near_links.near_links(views.vectors(spark, sf_dir), 0.3))
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("members")).filter("members >= 3")
    return labels.join(sizes, "community").select("node", "community", "members")


@query()
def communities_chosen(spark, sf_dir):
    """Communities of parent tasks, each component by the algorithm that suits its size, with each community's share of the modularity; tests compare with plain loops."""
    edges = views.relations(spark, sf_dir).filter("relation_type = 'parent_task' and source_id <> target_id").select("source_id", "target_id").distinct().withColumn("weight", F.lit(1.0))
    return graph_parts.chosen_communities(edges, 0.75)
