"""Mixing sources to target weights by balanced (cube) sampling.

A source's documents are taken ``target / source_size`` times on average: the whole part of that
factor for all of them, the fractional part by a sample. The sample starts from equal fractional
inclusion probabilities and moves them through the null space of two constraints (words and
documents), the largest unit first, until each is 0 or 1: the totals stay what they were. This runs
in blocks of a source; the units that a block can't settle (two at most) meet in larger blocks, level by level,
until a source has one block: that lands its last and smallest units by the rounding nearest to the word total,
whatever the size of the other sources.

Blocks and random numbers come from hashes of the rows, so reruns agree.

Defined cases: a null text has size 0; the null source is a source and comes last; rows without
doc_id and repeated rows are units like any other; a source without words has target 0 and is not taken;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialize, n_words

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
BLOCK = 1024
LANDING = 12
EPS = 1e-9
UNIT = "source string, block long, doc_id long, row_hash long, size long, pi double"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = MAX_REPEATS) -> DataFrame:
    """source, source_size, target for ``sizes`` (source, source_size: one row per source).

    The sum of all sizes is shared by weight; a target stops at ``limit`` times its source's size and
    the excess is shared again by weight among the rest, until none is above.
    """
    # places in the order of all sources, without a task that has them all: the place in a range and the rows of the ranges before
    by_source = F.col("source").asc_nulls_last()
    ranged = materialize(sizes.orderBy(by_source).withColumn("range", F.spark_partition_id()), "mix-order")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row per range
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(by_source)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = materialize(ranged.join(F.broadcast(before), "range").withColumn("weight", weight).select("source", "source_size", "weight"), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    room = F.lit(float(limit)) * F.col("source_size")
    level, capped = None, F.lit(False)
    while total:
        held, open_weight, n = table.agg(F.sum(F.when(capped, room)), F.sum(F.when(~capped, F.col("weight"))), F.sum(capped.cast("int"))).first()
        if not open_weight:
            break
        level = (total - (held or 0.0)) / open_weight
        now = capped | (F.lit(level) * F.col("weight") > room)
        if table.agg(F.sum(now.cast("int"))).first()[0] == n:
            break
        # the level only rises, so a source once capped stays so
        capped = now
    target = F.when(capped, room).otherwise(F.lit(level or 0.0) * F.col("weight")) if total else F.lit(0.0)
    return table.select("source", "source_size", target.cast("double").alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move the probabilities to 0 or 1 with sum(pi) and sum(pi * size) unchanged, until at most ``leave`` (two or more) stay between.

    Each step goes along the null space of the two constraints: the unit vector of the largest open unit, less its
    projection on (1, size) over the open units. So what a large unit gains or gives up is spread over all others. A step goes as far as
    some probability is 0 or 1, in a direction drawn so that the mean stays. Large units settle first; the last ones are small.
    """
    pi = pi.astype(float).copy()
    order = np.argsort(-size, kind="stable")
    index = order[(pi[order] > EPS) & (pi[order] < 1 - EPS)]
    scale = float(size.max(initial=1)) or 1.0
    while len(index) > leave:
        p, s = pi[index], size[index] / scale
        n, first, second = float(len(s)), s.sum(), s @ s
        spread = n * second - first * first
        lead = 0
        if spread > EPS * n * second:
            # a unit that the constraints alone decide (such as the only one of its size) can't lead
            free = np.flatnonzero((second - 2 * first * s + n * s * s) / spread < 1 - 1e-6)
            if not len(free):
                break
            lead = free[0]
            beta = (n * s[lead] - first) / spread
            u = -((1 - beta * first) / n + beta * s)
        else:  # equal sizes
            u = np.full(len(s), -1 / n)
        u[lead] += 1
        rises, falls = u > EPS, u < -EPS
        up = min(((1 - p[rises]) / u[rises]).min(), (p[falls] / -u[falls]).min())
        down = min((p[rises] / u[rises]).min(), ((1 - p[falls]) / -u[falls]).min())
        p = np.clip(p + u * (up if rng.random() * (up + down) < down else -down), 0.0, 1.0)
        pi[index] = p
        index = index[(p > EPS) & (p < 1 - EPS)]
    settled = (pi <= EPS) | (pi >= 1 - EPS)
    pi[settled] = np.round(pi[settled])
    return pi


def landing(size: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Round the last open units (``LANDING`` at most: all ways are tried) so that the word total is missed least, then the document total."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
    words, documents = np.abs((ways - pi[open_]) @ size[open_]), np.abs((ways - pi[open_]).sum(axis=1))
    pi = pi.copy()
    pi[open_] = ways[np.lexsort((documents, np.round(words, 6)))[0]]
    return pi


def _settle(seed: int):
    def settle(block: pa.Table) -> pa.Table:
        land = block["land"][0].as_py()
        block = block.drop_columns("land")
        block = block.take(pc.sort_indices(block, sort_keys=[(c, "ascending") for c in ("row_hash", "size", "pi")]))
        row_hash, size = block["row_hash"].to_numpy(), block["size"].to_numpy()
        mix = [seed, *(int(x) & 0xFFFFFFFF for x in (block["block"][0].as_py(), row_hash[0], row_hash[-1]))]
        pi = flight(size, block["pi"].to_numpy(), np.random.default_rng(mix), LANDING if land else 2)
        if land:
            pi = landing(size, pi)
        return block.set_column(block.schema.get_field_index("pi"), "pi", pa.array(pi))

    return settle


def cube_sample(units: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """source, doc_id, row_hash, size, pi in {0, 1} for ``units`` with fractional pi; balanced in each source.

    Each level hashes the open units of a source into blocks of about ``block`` and settles all but two of
    each block's; a source with one block lands and is done. log(rows) levels, and each shuffles only what is still open.
    """
    done, level = None, 0
    open_ = units
    while True:
        counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
        if counts.isEmpty():
            break
        spread = F.xxhash64("row_hash", "doc_id", "size", F.lit(seed + level))
        dealt = attach(open_, counts.select("source", "blocks"), "source", F.xxhash64("row_hash"))
        dealt = dealt.withColumn("block", F.pmod(spread, F.col("blocks")).cast("long")).withColumn("land", F.col("blocks") <= 1)
        settled = dealt.select("source", "block", "doc_id", "row_hash", "size", "pi", "land").groupBy("source", "block").applyInArrow(_settle(seed + level), UNIT)
        settled = materialize(settled, "mix-level")
        part = settled.filter("pi = 0 or pi = 1")
        done = part if done is None else done.unionByName(part)
        open_, level = settled.filter("pi > 0 and pi < 1").drop("block"), level + 1
    return (done if done is not None else units).select("source", "doc_id", "row_hash", "size", "pi")


def mix_sources(docs: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """doc_id, row_hash, size, source, source_size, target, copies for each row of ``docs`` (doc_id, text, source)."""
    sized = docs.select("doc_id", "source", n_words("text").alias("size"), (F.xxhash64("doc_id", "text") if row_hash is None else row_hash).alias("row_hash"))
    sized = materialize(sized, "mix-sizes")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = targets.select("source", "source_size", "target", factor.alias("factor"))
    rows = attach(sized, shares, "source", F.col("row_hash"))
    rows = rows.withColumn("whole", F.floor(F.col("factor") + EPS)).withColumn("pi", F.greatest(F.lit(0.0), F.col("factor") - F.col("whole")))
    rows = rows.withColumn("pi", F.when(F.col("pi") > 2 * EPS, F.col("pi")).otherwise(0.0))
    sample = cube_sample(rows.filter("pi > 0").select("source", "doc_id", "row_hash", "size", "pi"))
    fixed = rows.filter("pi = 0").select("source", "doc_id", "row_hash", "size", F.lit(0.0).alias("extra"))
    every = fixed.unionByName(sample.withColumnRenamed("pi", "extra"))
    out = attach(every, shares.withColumn("whole", F.floor(F.col("factor") + EPS)), "source", F.col("row_hash"))
    return out.select("doc_id", "row_hash", "size", "source", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Equal rows are taken together."""
    key = F.xxhash64(*docs.columns)
    # plain keys without nulls, so that both steps share one shuffle of the texts
    own, named = F.coalesce("doc_id", F.lit(-1)).cast("long"), F.col("doc_id").isNotNull()
    taken = mix_sources(docs, key).groupBy(own.alias("_mix_id"), named.alias("_mix_named"), F.col("row_hash").alias("_mix_row")).agg(F.sum("copies").alias("_mix_copies"))
    keys = ["_mix_id", "_mix_named", "_mix_row"]
    once = docs.withColumns({"_mix_id": own, "_mix_named": named, "_mix_row": key}).dropDuplicates(keys)
    both = once.join(taken.filter("_mix_copies > 0").hint("merge"), keys)
    return both.withColumn("_mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_mix_copies"))).select(docs.columns)
