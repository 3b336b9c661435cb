"""Graph operators over an edge table (source_id, target_id, ...): rounds of joins, written between rounds."""

from __future__ import annotations

from functools import partial
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import new_path
from .packed_links import Block, Packed, Told, best_of, packed, runs, summed, thinned

if TYPE_CHECKING:
    from .near_links import Chunk, NearLinks

    Links = Packed | NearLinks


def cut(df: DataFrame, label: str = "graph") -> DataFrame:
    """Write to the shared checkpoint folder and read back, so that a loop's plan stays short and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b) in walking direction: forward, backward or both."""
    there = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"forward": there, "backward": back}.get(direction, there.unionByName(back)).distinct()


def reachable(starts: DataFrame, edges: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """(start, node, depth) for nodes within ``depth`` (1 to 5) steps of each start, without the start itself.

    Breadth first: each round joins the frontier with the edges and drops what was seen.
    """
    edges = cut(directed(edges, direction))
    frontier = starts.select(F.col("node").alias("start"), "node").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for step in range(1, max(1, min(5, depth)) + 1):
        reached = frontier.join(edges, frontier["node"] == edges["a"]).select("start", F.col("b").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(step)))
    return seen.filter("depth > 0")


def simple_paths(start: int, goal: int, edges: DataFrame, depth: int = 4) -> DataFrame:
    """(path, steps): paths along the edges without a repeated node, at most ``depth`` edges long."""
    edges = cut(directed(edges, "forward"))
    paths = edges.filter(F.col("a") == start).select(F.array("a", "b").alias("path"), F.col("b").alias("last")).filter("path[0] <> last")
    found = None
    for step in range(1, depth + 1):
        done = paths.filter(F.col("last") == goal).select("path", F.lit(step).alias("steps"))
        found = done if found is None else found.unionByName(done)
        if step < depth:
            longer = paths.filter(F.col("last") != goal).join(edges, F.col("last") == F.col("a")).filter(~F.array_contains("path", F.col("b")))
            paths = cut(longer.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("last")))
    return found


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes without edges don't appear.

    Tasks first thin their links to those that hold their nodes together. Then rounds of smallest neighbouring label, then of the label's own label, until nothing changes.
    """
    both = thinned(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    both = cut(by_node(both_ways(both)))  # a link more than once does no harm here
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.least("root", "low").alias("next"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = cut(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), "was"))
        changed = new.filter("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a parent table (node, parent), each ancestor once at its smallest depth, however far up it is.

    Each round doubles the reach: whoever is exactly 2^k above a node brings all of its own known ancestors along.
    On a cycle a node becomes its own ancestor and the walk ends there, since a round without new pairs is the last.
    """
    known = cut(parents.filter("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while True:
        top = known.filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"), F.col("depth").alias("below"))
        above = known.select(F.col("node").alias("via"), "ancestor", F.col("depth").alias("above"))
        far = top.join(above, "via").groupBy("node", "ancestor").agg(F.min(F.col("below") + F.col("above")).alias("depth"))
        new = cut(far.join(known, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        known, reach = cut(known.unionByName(new)), reach * 2


def both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """(a, b, ...) of ``pairs`` in both directions; what makes the pairs runs once."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    return pairs.select(ends, *more).select("e.a", "e.b", *more)


def by_node(links: DataFrame) -> DataFrame:
    """``links`` (a, b, ...) with those of a node a in few tasks, so that sums by node are small before they move; a node of many links is spread over eight."""
    return links.repartition("a", F.pmod(F.xxhash64("b"), F.lit(8)))


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community): synchronous label propagation by edge weight (column ``weight``); ties to the smaller label.

    Every second round may only lower a label, which stops two nodes from swapping labels for ever.
    """
    return voted(packed(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w"))), rounds)


def voted(links: Links, rounds: int = 8) -> DataFrame:
    """The same over links in blocks, which are dropped."""
    labels = cut(links.nodes().select("node", F.col("node").alias("community")))

    def vote(lower: bool, block: Block | Chunk, told: Told) -> pd.DataFrame:
        label = told["community"]
        row, c, w = summed(block, label)
        choice = c[best_of(row, np.rint(w * 1e6))]
        return pd.DataFrame({"node": block.nodes, "community": np.minimum(choice, label[block.own]) if lower else choice})

    for k in range(rounds):
        labels = cut(links.round(labels, partial(vote, k % 2 == 1), "node long, community long"))
    links.drop()
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Newman modularity of a labelling of an undirected weighted graph."""
    a = labels.select(F.col("node").alias("source_id"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("target_id"), F.col("community").alias("cb"))
    joined = edges.join(a, "source_id").join(b, "target_id")
    total = joined.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    inside = joined.filter("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    ends = joined.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / total - (ends.agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0) / (4 * total * total)


_MOVED = "node long, community long, k double, quality double"


def _move(double_total: float, block: Block | Chunk, told: Told) -> pd.DataFrame:
    """A block's nodes after those whose turn it is went to the neighbouring community of the largest gain in modularity, and the share of the modularity before."""
    label, total, turn = (told[c] for c in ("community", "total", "turn"))
    at, row = block.own, block.row
    k = np.bincount(row, weights=block.w, minlength=len(at))
    alike = label[at][row] == label[block.at]
    inside = np.bincount(row, weights=np.where(alike, block.w, 0.0), minlength=len(at))
    loops = block.at == at[row]
    here = inside - np.bincount(row, weights=np.where(loops, block.w, 0.0), minlength=len(at)) - k * (total[at] - k) / double_total
    new = label[at].copy()
    row, c, w = summed(block, label, turn[at][row] & ~loops & ~alike)
    if len(row):
        names, first, _ = block.names(label)
        gain = np.round(w - k[row] * total[first][np.searchsorted(names, c)] / double_total, 9)
        best = best_of(row, gain)
        best = best[gain[best] > np.round(here, 9)[row[best]]]
        new[row[best]] = c[best]
    quality = inside.sum() / double_total - (k * total[at]).sum() / double_total**2
    return pd.DataFrame({"node": block.nodes, "community": new, "k": k, "quality": np.where(np.arange(len(at)) == 0, quality, 0.0)})


def _between(block: Block | Chunk, told: Told) -> pd.DataFrame:
    """The block's links as links of communities."""
    label = told["community"]
    row, c, w = summed(block, label)
    own = label[block.own][row]
    order = np.lexsort((c, own))
    first = runs(own[order], c[order])
    return pd.DataFrame({"a": own[order][first], "b": c[order][first], "w": np.add.reduceat(w[order], first)})


def _added(links: pd.DataFrame) -> pd.DataFrame:
    return links.groupby(["a", "b"], as_index=False)["w"].sum()


def _turned(links: Links, labels: DataFrame, double_total: float, turn: int) -> DataFrame:
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
    half = F.pmod(F.xxhash64("node", F.lit(turn // 2)) + turn % 2, F.lit(2)) == 0
    facts = labels.join(totals, "community").select("node", "community", "total", half.alias("turn"))
    return cut(links.round(facts, partial(_move, double_total), _MOVED))


def moved_communities(links: DataFrame | Links, double_total: float, least_gain: float = 1e-4, among: DataFrame | None = None) -> DataFrame:
    """(node, community) by synchronous modularity moves over weighted links (a, b, w), each in one direction; a community is named after its smallest node.

    In each round a hashed half of the nodes moves to the neighbouring community of the largest gain, then the other half, so two
    nodes don't swap for ever. A round that does not raise the modularity by more than ``least_gain`` is taken back and the
    communities become the nodes of the next level. Levels end when nothing merges, so modularity never falls. ``double_total``: twice the weight of
    the whole graph, of which ``links`` may be a part. Links stay in blocks (``packed_links``); a round also returns the modularity of the labels it is given. ``among``: the nodes that are moved, whole components, or all.
    """
    level, of, turn = packed(links) if isinstance(links, DataFrame) else links, None, 0
    while True:
        nodes = level.nodes().select("node", "k")
        nodes = cut(nodes.join(among, "node", "left_semi") if among is not None and of is None else nodes)
        labels, kept, quality = nodes.select("node", F.col("node").alias("community"), "k"), None, None
        while True:
            turn += 2
            half = _turned(level, labels, double_total, turn)
            now = half.agg(F.sum("quality")).first()[0] or 0.0
            if quality is not None and now <= quality + least_gain:
                break
            kept, quality = labels, now
            labels = _turned(level, half.drop("quality"), double_total, turn + 1).drop("quality")
        names = kept.groupBy("community").agg(F.min("node").alias("name"))
        labels = cut(kept.join(names, "community").select("node", F.col("name").alias("community")))
        of = labels if of is None else cut(of.join(labels.toDF("community", "next"), "community").select("node", F.col("next").alias("community")))
        if labels.filter("node <> community").isEmpty():
            level.drop()
            return of
        shrunk = cut(level.round(labels, _between, "a long, b long, w double", _added).groupBy("a", "b").agg(F.sum("w").alias("w")))
        level.drop()
        level = packed(shrunk, both=False)


def neighbours(edges: DataFrame, nodes: list[int], side: str = "both", types: list[str] | None = None) -> DataFrame:
    """(at, node, relation_type, side) of the stated ``nodes`` along edges (source_id, target_id, relation_type) of the given types."""
    chosen = edges.filter(F.col("relation_type").isin(types)) if types else edges
    out = chosen.filter(F.col("source_id").isin(nodes)).select(F.col("source_id").alias("at"), F.col("target_id").alias("node"), "relation_type", F.lit("out").alias("side"))
    back = chosen.filter(F.col("target_id").isin(nodes)).select(F.col("target_id").alias("at"), F.col("source_id").alias("node"), "relation_type", F.lit("in").alias("side"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[side]
