"""Vector operators: cosine, k-NN, similarity joins, quantisation, projection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metric_join
from .graph import cut
from .graph_parts import greedy_degree_cap


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where the sizes differ, a norm is zero, or the value is not finite."""
    size = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)
    return F.when(F.isnan(value) | F.isnull(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def knn(vectors: DataFrame, query: list[float], k: int, min_similarity: float = 0.0) -> DataFrame:
    """The k nearest by cosine, clamped to 0..1; each task keeps k rows."""
    sim = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(F.col("v"), literal(query)))), 6)
    return vectors.withColumn("similarity", sim).filter(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), "vec_id").limit(k)


BLOCK = 2048
#: Pairs of a band of similarities: for each vector, and in all if that is more; vectors whose pairs tell where bands end.
BAND, SAMPLED = (8, 1_000_000), 2048


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with cosine at least ``threshold``, rounded to six digits: exact.

    Few vectors are compared in blocks. More are joined as packed distinct vectors, by metric regions as long as those save something
    at this threshold (``metric_join``). Null and zero vectors have no pairs if the threshold is above 0.
    """
    if threshold <= 0:
        return block_pairs(vectors, vectors.count(), threshold, block)
    able = vectors.filter(norm(F.col("v")) > 0)
    n = able.count()
    if n <= 2 * block:
        return block_pairs(able, n, threshold, block)
    found, members = similar_classes(able, threshold, block)
    return metric_join.spread_out(found, members)


def similar_classes(vectors: DataFrame, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) between the smallest ids of equal vectors, and (cls, vec_id), the members of each such class of two and more."""
    rows, members = metric_join.classes(vectors.filter(norm(F.col("v")) > 0))
    n = rows.count()
    found = block_pairs(rows, n, threshold, block) if n <= 2 * block else metric_join.class_pairs(rows, n, threshold, 8 * block)
    return found, members


def similar_links(vectors: DataFrame, threshold: float, block: int = 8 * BLOCK) -> DataFrame:
    """(node, root, n, s): what ``similar_pairs`` hold together, and how many pairs with what sum, without the pairs (``metric_join.class_links``); ``threshold``: above 0."""
    return metric_join.class_links(*metric_join.classes(vectors.filter(norm(F.col("v")) > 0)), threshold, block)


def block_pairs(vectors: DataFrame, n: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """The pairs by comparing all of the ``n`` vectors in blocks.

    Vectors are dealt into blocks by id hash; a task multiplies one pair of blocks, so no task
    holds more than two blocks, and only pairs above the threshold leave it.
    """
    dealt = _dealt(vectors.withColumn("blocks", F.lit(max(1, math.ceil(n / block)))), [])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        a, b, sims = _met(group, threshold)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": sims})

    return dealt.groupBy("i", "j").applyInPandas(join, "a long, b long, similarity double")


def _dealt(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Each vector (vec_id, v, blocks) once for each block that its own one meets: i and j are the pair of blocks, own its own."""
    rows = vectors.select(*keys, "vec_id", "v", "blocks", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("own"))
    dealt = rows.select(*keys, "vec_id", "v", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(*keys, "vec_id", "v", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), "own")


def _met(group: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and cosines of the pairs of one pair of blocks, each pair once."""
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left, right = group[group["own"] == i], group[group["own"] == j]
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    sims = np.round(metric_join.unit(left["v"]) @ metric_join.unit(right["v"]).T, 6)
    x, y = np.nonzero(sims >= threshold)
    a, b = left["vec_id"].to_numpy()[x], right["vec_id"].to_numpy()[y]
    keep = a < b if i == j else a != b
    return a[keep], b[keep], sims[x, y][keep]


def cohesion(vectors: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, pairs, mean, low, high) of the cosines inside each group: only sums leave a task, and a large group is many tasks."""
    sizes = vectors.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = _dealt(vectors.join(sizes, key), [key])

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        sims = _met(group, -2.0)[2]
        n = len(sims)
        return pd.DataFrame({key: [group[key].iloc[0]], "n": [n], "s": [sims.sum()], "low": [sims.min() if n else None], "high": [sims.max() if n else None]})

    kind = vectors.schema[key].dataType.simpleString()
    parts = dealt.groupBy(key, "i", "j").applyInPandas(sums, f"{key} {kind}, n long, s double, low double, high double")
    by = parts.groupBy(key).agg(F.sum("n").alias("pairs"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    return by.filter("pairs > 0").select(key, "pairs", (F.col("s") / F.col("pairs")).alias("mean"), "low", "high")


def band_floor(rows: DataFrame, n: int, threshold: float, below: float, pairs: int) -> float:
    """The similarity, at least ``threshold``, from which up some ``pairs`` of the pairs of ``rows`` under ``below`` lie, by those of a sample."""
    if n * (n - 1) // 2 <= pairs:
        return threshold
    m = metric_join.unit(rows.select("v").orderBy(F.xxhash64("vec_id", F.lit(61)), "vec_id").limit(SAMPLED).toPandas()["v"])
    sims = (m @ m.T)[np.triu_indices(len(m), 1)]
    sims = np.sort(sims[(sims >= threshold) & (sims < below)])[::-1]
    at = int(pairs * len(m) * (len(m) - 1) / (n * (n - 1)))
    if at >= len(sims):
        return threshold
    return max(threshold, min(1.0, below - 0.01, round(float(sims[at]), 3)))


def nearest_edges(vectors: DataFrame, threshold: float, cap: int = 5, band: tuple[int, int] = BAND) -> DataFrame:
    """(a, b, score): ``greedy_degree_cap`` of the similar pairs, where equal vectors cost no pairs and no rounds.

    The best pairs come first: a band of similarities at a time, of some pairs for each vector (``band``: these, and as many as any band may have), is settled to its end, and
    only vectors that have room left are compared for the next. So pairs that nobody has room for are never kept.

    Pairs of equal vectors come first, by id: each ``cap + 1`` copies in the order of their ids are linked among
    themselves and full. Only the last few copies of a vector and vectors without copies take part in the join.
    A vector that ties with others at 1.0 by rounding takes part with all its copies.
    """
    full = cap + 1
    rows = vectors.select("vec_id", "v", F.xxhash64("v").alias("h"), (norm(F.col("v")) > 0).alias("able")).filter("able")
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    placed = rows.withColumn("place", F.row_number().over(order) - 1)
    sizes = rows.groupBy("h", "v").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("cls"))
    placed = placed.join(sizes.hint("merge"), ["h", "v"]).withColumn("whole", F.col("place") < F.col("size") - F.col("size") % full)
    placed = cut(placed.select("vec_id", "v", "cls", "place", "whole"))
    # what is left, and the first copy of each vector, which stands for the copies that are full
    able = cut(placed.filter("not whole or vec_id = cls").select("vec_id", "v"))
    n = able.count()
    floor = band_floor(able, n, threshold, 2.0, max(band[0] * n, band[1]))
    pairs = cut(similar_pairs(able, floor))
    known = placed.select("vec_id", "cls", "whole")
    a, b = known.toDF("a", "cls_a", "whole_a"), known.toDF("b", "cls_b", "whole_b")
    both = pairs.join(a, "a").join(b, "b")
    tied = cut(both.filter("similarity >= 1.0 and cls_a <> cls_b").select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct())
    if not tied.join(placed.filter("whole and vec_id = cls"), "cls").isEmpty():
        placed = cut(placed.join(tied.withColumn("tied", F.lit(True)), "cls", "left").withColumn("whole", F.col("whole") & F.col("tied").isNull()).drop("tied"))
        pairs = similar_pairs(placed.filter("not whole").select("vec_id", "v"), floor)
    else:
        pairs = both.filter("not whole_a and not whole_b")
    blocks = placed.filter("whole").groupBy("cls", F.floor(F.col("place") / full).alias("block")).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    x = blocks.select("ids", F.posexplode("ids").alias("i", "a"))
    out = x.select("a", F.explode(F.slice("ids", F.col("i") + 2, full)).alias("b"), F.lit(1.0).alias("score"))
    rows = placed.filter("not whole").select("vec_id", "v", F.lit(cap).alias("room"))
    while True:
        score = [c for c in ("a", "b", "ra", "rb") if c in pairs.columns]
        taken = greedy_degree_cap(pairs.select(*score, F.col("similarity").alias("score")), cap)
        if floor <= threshold:
            return out.unionByName(taken)
        taken = cut(taken)
        out = out.unionByName(taken)
        used = taken.select(F.explode(F.array("a", "b")).alias("vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
        rows = cut(rows.join(used, "vec_id", "left").withColumn("room", (F.col("room") - F.coalesce("n", F.lit(0))).cast("int")).drop("n").filter("room > 0"))
        n, below = rows.count(), floor
        floor = band_floor(rows, n, threshold, below, max(band[0] * n, band[1]))
        found = similar_pairs(rows.select("vec_id", "v"), floor).filter(F.col("similarity") < below)
        room = rows.select("vec_id", "room")
        pairs = cut(found.join(room.toDF("a", "ra"), "a").join(room.toDF("b", "rb"), "b"))


def quantise(v: Column, low: float, high: float, bits: int = 8) -> Column:
    """Codes 0 .. 2^bits - 1 over a stated range."""
    top = (1 << bits) - 1
    return F.transform(v, lambda x: F.floor((F.least(F.lit(high), F.greatest(F.lit(low), x)) - low) / (high - low) * top + 0.5).cast("int"))


def dequantise(codes: Column, low: float, high: float, bits: int = 8) -> Column:
    top = (1 << bits) - 1
    return F.transform(codes, lambda c: F.lit(low) + c / top * (high - low))


def sparse_projection(dim: int, out: int, seed: int = 42) -> list[list[tuple[int, float]]]:
    """Rows of an Achlioptas matrix (s = 3): (input place, signed scale) where it isn't zero."""
    r = np.random.default_rng(seed).random((out, dim))
    scale = math.sqrt(3 / out)
    return [[(j, scale if r[i, j] < 1 / 6 else -scale) for j in range(dim) if r[i, j] < 1 / 3] for i in range(out)]


def project(v: Column, rows: list[list[tuple[int, float]]]) -> Column:
    """The projection as plain column arithmetic."""
    terms = [sum((F.element_at(v, j + 1) * s for j, s in row), F.lit(0.0)) for row in rows]
    return F.array(*terms)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, place, value): the mean of each coordinate."""
    return vectors.select(key, F.posexplode("v").alias("place", "x")).groupBy(key, "place").agg(F.avg("x").alias("value"))


def hierarchy(vectors: DataFrame, levels: int = 2, threshold: float = 0.5) -> DataFrame:
    """(level, node, parent): communities of similar vectors, then of their centroids, and so on.

    A parent is named after its smallest community label; a node without similar ones is its own parent.
    """
    from .graph import voted
    from .near_links import near_links

    current, out = cut(vectors.select("vec_id", "v")), None
    for level in range(levels):
        labels = voted(near_links(current, threshold))
        members = cut(current.join(labels, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("community", "vec_id").alias("parent"), "v"))
        step = members.select(F.lit(level).alias("level"), F.col("vec_id").alias("node"), "parent")
        out = step if out is None else out.unionByName(step)
        middle = centroids(members, "parent").groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("v"))
        current = cut(middle.select(F.col("parent").alias("vec_id"), "v"))
    return out


def recoded(v: str, low: str, high: str, bits: int) -> Column:
    """A vector after a round trip through signed codes over the range of two columns; values outside it are clamped."""
    least, top = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    lo, width = F.col(low), F.col(high) - F.col(low)
    code = lambda x: F.greatest(F.lit(least), F.least(F.lit(top), F.floor((x - lo) / width * (top - least) + least + 0.5)))
    return F.transform(v, lambda x: (code(x) - least) / (top - least) * width + lo)


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, v): the centroid of each key as an array."""
    places = F.array_sort(F.collect_list(F.struct("place", "value")))
    return centroids(vectors, key).groupBy(key).agg(F.transform(places, lambda s: s["value"]).alias("v"))


def descend(levels: list[DataFrame], query: Column, factor: int = 3, least: float = 0.5) -> list[int]:
    """The nodes of the lowest level that a search from the top reaches. ``levels`` (node, parent, v) from the top.

    At each level the children of the nodes found so far, ``factor`` for each of those, that have a similarity of at least
    ``least``. What comes to the driver is at most factor ** levels ids.
    """
    found: list[int] | None = None
    for nodes in levels:
        rows = nodes if found is None else nodes.filter(F.col("parent").isin(found))
        scored = rows.select("node", F.round(cosine(F.col("v"), query), 6).alias("s")).filter(F.col("s") >= least)
        found = [r["node"] for r in scored.orderBy(F.desc("s"), "node").limit(factor * max(1, len(found or ()))).collect()]
        if not found:
            return []
    return found or []
