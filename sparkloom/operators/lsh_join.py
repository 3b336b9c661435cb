"""Similarity join by random hyperplanes with query-directed probes.

In each of several tables a vector lies in the bucket of its signs on some random planes, and looks in that bucket and in those that
differ in the signs it is least sure of (smallest squared distances to the planes first). How many planes, probes and tables follows from the
threshold and the wanted recall: ``design`` draws pairs at exactly the threshold and takes the cheapest setting that finds them. The planes go through the
vectors' mean, since vectors that have a part in common would else all lie on the same side of most; seen from there, the threshold's angle is wider, and
the design is for that.

Below ``EXACT`` vectors, and where no setting compares fewer than half of all pairs, the exact join is run. Of equal vectors one takes part. A vector keeps its
``most`` best partners: each task keeps that many of its own, then the best of those; an edge stays if either end keeps it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metric_join, vector
from .graph import cut

EXACT, MOST, BLOCK = 100, 100, 4096
#: Pairs that a setting is judged by, and tables it may have at most.
DRAWN, MAX_TABLES = 1000, 64
#: Settings that compare this share of all pairs, or more, are no gain.
WORTH = 0.5
#: Products that shuffling a probe costs as much as; owners whose pairs a task holds before it keeps the best of them.
PROBE, STRIP = 1500, 512


@dataclass(frozen=True)
class Design:
    bits: int
    probes: int
    tables: int
    share: float  # of all pairs that two unrelated vectors' tables compare


def planes(dim: int, tables: int, bits: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def flips(bits: int) -> np.ndarray:
    """Sets of no, one and two planes, as rows of 0 and 1."""
    eye = np.eye(bits, dtype=np.int64)
    pairs = [eye[i] + eye[j] for i in range(bits) for j in range(i)]
    return np.concatenate([np.zeros((1, bits), dtype=np.int64), eye, np.array(pairs, dtype=np.int64).reshape(-1, bits)])


def probed(margins: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes): codes of the buckets to look in, likeliest first, from signed distances to the planes (rows, bits)."""
    bits = margins.shape[1]
    weight = 1 << np.arange(bits)
    own = (margins > 0) @ weight
    sets = flips(bits)
    cost = (margins**2) @ sets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    # flipping a plane changes its bit, whatever it was: an exclusive or
    return own[:, None] ^ (sets @ weight)[best]


@lru_cache(maxsize=64)
def design(n: int, dim: int, threshold: float, recall: float, seed: int = 3) -> Design | None:
    """The setting that compares the fewest pairs while finding pairs at ``threshold`` with probability ``recall``; None if none compares fewer than half of all pairs."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((DRAWN, dim)), rng.standard_normal((DRAWN, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    best = None
    for bits in range(4, min(24, max(5, math.ceil(math.log2(max(n, 2))) + 4)), 2):
        p = planes(dim, 1, bits, seed)[0]
        left, right = x @ p.T, y @ p.T
        own_x, own_y = probed(left, 1), probed(right, 1)
        most = min(len(flips(bits)), 1 + 4 * bits)
        from_x, from_y = probed(left, most) == own_y, probed(right, most) == own_x
        for probes in sorted({1, 1 + bits // 2, 1 + bits, 1 + 2 * bits, most}):
            rate = float((from_x[:, :probes].any(1) | from_y[:, :probes].any(1)).mean())
            if rate <= 0:
                continue
            tables = 1 if rate >= recall else math.ceil(math.log(1 - recall) / math.log(1 - rate))
            share = 2 * tables * probes / 2**bits
            cost = share * n / 2 + PROBE * tables * (probes + 1)
            if tables <= MAX_TABLES and share < WORTH and (best is None or cost < best[0]):
                best = cost, Design(bits, probes, tables, share)
    return best[1] if best else None


def lsh_pairs(vectors: DataFrame, threshold: float, recall: float = 0.95, most: int | None = MOST, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of pairs a < b with cosine at least ``threshold``, among the ``most`` best of either; about ``recall`` of them, exact values.

    Partners of one vector beyond ``most`` are left out by definition; None keeps all. Of equal vectors the one with the smallest id takes part,
    and each other one is linked to it, with 1.0.
    """
    rows, members = metric_join.classes(vectors.filter(vector.norm(F.col("v")) > 0))
    n = rows.count()
    dim = (rows.select(F.size("v").alias("n")).first() or {"n": 1})["n"]
    mean = centre(rows, n, dim) if n >= EXACT else np.zeros(dim)
    apart = 1 - float(mean @ mean)  # mean squared distance from the centre
    around = 1 - (1 - threshold) / apart if apart > 1 - threshold else 0.0
    plan = design(n, dim, round(around, 3), recall) if n >= EXACT and around > 0 else None
    found = _met(rows, threshold, plan, mean, most, block) if plan else vector.similar_classes(rows, threshold, block)[0]
    copies = members.filter("cls <> vec_id").select(F.col("cls").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("similarity"))
    return _kept(found, most).unionByName(copies)


def centre(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """The mean of the unit vectors; each task returns one sum."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dim)
        for f in frames:
            if len(f):
                total += metric_join.unit(f["v"]).sum(axis=0)
        yield pd.DataFrame({"x": [total]})

    parts = rows.select("v").mapInPandas(sums, "x array<double>").select(F.posexplode("x").alias("at", "x"))
    out = np.zeros(dim)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"] / n
    return out


def _kept(pairs: DataFrame, most: int | None) -> DataFrame:
    """Pairs that are among the ``most`` best of one of their ends, ties to the smaller partner."""
    if most is None:
        return pairs
    ends = pairs.select("a", "b", "similarity", F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("b").alias("other")), F.struct(F.col("b").alias("end"), F.col("a").alias("other")))).alias("e"))
    order = Window.partitionBy("e.end").orderBy(F.desc("similarity"), "e.other")
    ranked = ends.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("a", "b", "similarity").distinct()


def among_best(end: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Whether each pair may be among the ``most`` best of its ``end``, given the bounds of its cosine."""
    order = np.lexsort((-low, end))
    first = np.flatnonzero(np.diff(end[order], prepend=-1))
    n = np.diff(first, append=len(order))
    least = np.full(len(first), -2.0)
    least[n > most] = low[order][first[n > most] + most - 1]
    out = np.empty(len(order), dtype=bool)
    out[order] = high[order] >= np.repeat(least, n)
    return out


def _hits(left: np.ndarray, right: np.ndarray, left_off: np.ndarray, right_off: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, threshold: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of packed vectors that may reach ``threshold`` and, some owners at a time and then all, be among the ``most`` best of either end."""

    def pruned(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if most is None or len(x) <= most:
            return x, y
        at = range(0, len(x), metric_join.LEFT_OVER)
        sims = np.concatenate([np.einsum("ij,ij->i", left[x[k : k + metric_join.LEFT_OVER]], right[y[k : k + metric_join.LEFT_OVER]]) for k in at])
        slack = left_off[x] + right_off[y] + left_off[x] * right_off[y] + 1e-5
        kept = among_best(x, sims - slack, sims + slack, most) | among_best(y, sims - slack, sims + slack, most)
        return x[kept], y[kept]

    found = [(np.zeros(0, dtype=np.int64),) * 2]
    for at in range(0, len(left), STRIP):
        x, y = metric_join.near_packed(left[at : at + STRIP], right, left_off[at : at + STRIP], right_off, threshold, left.shape[1], False)
        other = left_ids[at + x] != right_ids[y]
        found.append(pruned(at + x[other], y[other]))
    return pruned(*(np.concatenate(z) for z in zip(*found)))


def _met(rows: DataFrame, threshold: float, plan: Design, mean: np.ndarray, most: int | None, block: int) -> DataFrame:
    """Pairs that share a probed bucket in any table. A crowded bucket is several tasks of ``block`` owners and ``block`` probers each.

    What goes to the buckets are packed vectors, an eighth of the size. Their product is off by no more than their two errors allow, so a task
    returns all pairs that may reach the threshold; the exact cosine of those decides.
    """
    cuts = planes(len(mean), plan.tables, plan.bits)

    @F.pandas_udf("codes array<array<int>>, q binary, step double, off double")
    def placed(vs: pd.Series) -> pd.DataFrame:
        m = metric_join.unit(vs)
        codes, step, off = metric_join.packed(m)
        return pd.DataFrame({"codes": np.stack([probed((m - mean) @ p.T, plan.probes) for p in cuts], axis=1).astype(np.int32).tolist(), "q": [c.tobytes() for c in codes], "step": step, "off": off})

    # by way of a generator, so that a row's buckets are found once
    coded = cut(rows.select("vec_id", F.explode(F.array(placed("v"))).alias("p")).select("vec_id", "p.*"), "lsh")
    tables = coded.select("vec_id", "q", "step", "off", F.posexplode("codes").alias("t", "codes"))
    own = tables.select("t", F.col("codes")[0].alias("code"), "vec_id", "q", "step", "off")
    asking = tables.select("t", F.explode("codes").alias("code"), "vec_id", "q", "step", "off")
    crowd = own.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))  # buckets with owners
    askers = asking.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("askers"))
    parts = cut(crowd.join(askers, ["t", "code"]), "lsh-parts")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    kept = ("t", "code", "vec_id", "q", "step", "off")
    owners = own.join(parts, ["t", "code"]).select(*kept, deal("parts").alias("i"), every("askers").alias("j"), F.lit(True).alias("owner"))
    probers = asking.join(parts, ["t", "code"]).select(*kept, every("parts").alias("i"), deal("askers").alias("j"), F.lit(False).alias("owner"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        mine = group["owner"].to_numpy()
        ids, off, m = group["vec_id"].to_numpy(), group["off"].to_numpy(), metric_join.unpacked(group)
        x, y = _hits(m[mine], m[~mine], off[mine], off[~mine], ids[mine], ids[~mine], threshold, most)
        a, b = ids[mine][x], ids[~mine][y]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    met = cut(owners.unionByName(probers).groupBy("t", "code", "i", "j").applyInPandas(meet, "a long, b long").distinct(), "lsh-met")
    return metric_join.exact(met, rows, threshold)
