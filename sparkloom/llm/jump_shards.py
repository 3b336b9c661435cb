"""Sharding by jump consistent hashing, as column expressions.

A key walks upwards through shard numbers: from shard b its next jump goes to a later shard j, drawn by a linear congruential
step from the key. Its shard among n is the last jump below n. No ring or table of shards exists, and since the walk does
not depend on n, one more shard takes only the keys whose next jump is exactly n. That jump is returned as ``moves_at``.

The 64-bit step is done in halves of 32 bits, so that no product leaves a signed long and the result is the same
with and without ANSI checks.

Defined cases: the key is hashed first, so any type may be one; all rows with one key, null too, share a shard, as the law
says. A null text has no bytes: its size is that of the row's overhead, its checksum 0. Repeated rows get one slot each.
Columns other than the key and the text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .numbering import ranked

# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW, _MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF
#: A row's bytes besides its text.
ROW_BYTES = 8
#: Steps that nearly every walk ends within; a walk takes about ln(shards) + 1.
SHORT_WALK = 32


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _low_product(x: Column, factor: int) -> Column:
    """A number that equals x * factor modulo 2^32, for x below 2^32; below 2^49."""
    return _and(x, 0xFFFF) * factor + F.shiftleft(_and(F.shiftright(x, 16) * factor, 0xFFFF), 16)


def _stepped(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of state * MULTIPLIER + 1 modulo 2^64."""
    upper = F.shiftright(low, 16) * _LOW
    sums = _low_product(low, _LOW) + 1
    carry = F.shiftright(sums, 32) + F.shiftright(upper, 16)
    return _and(carry + _low_product(high, _LOW) + _low_product(low, _HIGH), _MASK), _and(sums, _MASK)


def _walk(state: Column, shards: int, steps: int) -> Column:
    """``state`` (shard, next, high, low) after ``steps`` jumps, or as many as end below ``shards``."""

    def jump(s: Column, _: Column) -> Column:
        high, low = _stepped(s["high"], s["low"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")
        further = ((s["next"] + 1).cast("double") * ratio).cast("long")
        return F.when(s["next"] >= shards, s).otherwise(F.struct(s["next"].alias("shard"), further.alias("next"), high.alias("high"), low.alias("low")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, jump)


def jump_walk(key: Column, shards: int) -> Column:
    """Struct of shard (0 to shards - 1) and next (the later shard this 64-bit key goes to when there are more)."""
    high, low = _and(F.shiftrightunsigned(key, 32), _MASK), _and(key, _MASK)
    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"), high.alias("high"), low.alias("low"))
    walked = _walk(start, shards, min(shards, SHORT_WALK))
    if shards > SHORT_WALK:  # each jump goes up by one at least, so this one ends for certain
        walked = F.when(walked["next"] >= shards, walked).otherwise(_walk(walked, shards, shards))
    return walked


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, moves_at, slot of each row; slots count the rows of a shard from 0 by key, checksum and size.

    Only these few numbers of a row are shuffled, once, by ranges of (shard, key): a shard is as many tasks as it needs.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    walk = docs.select(F.col(key).alias("_key"), size.alias("_size"), crc.alias("_crc"), jump_walk(F.xxhash64(key), shards).alias("_walk"))
    rows = walk.select("_key", "_size", "_crc", F.col("_walk.shard").cast("int").alias("_shard"), F.col("_walk.next").alias("_next"))
    placed = ranked(rows, ["_shard", "_key", "_crc", "_size"], "shards")
    first = placed.groupBy("_shard").agg(F.min("_rank").alias("_first"))  # a row for each shard
    out = placed.join(F.broadcast(first), "_shard")
    return out.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), F.col("_next").alias("moves_at"), (F.col("_rank") - F.col("_first")).alias("slot"),
    )


def grown(shard: Column, moves_at: Column, shards: int) -> Column:
    """The shard when there is one more than ``shards``."""
    return F.when(moves_at == shards, F.lit(shards)).otherwise(shard).cast("int")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", files: int = 1) -> DataFrame:
    """Write all columns of ``docs`` below ``path``/_shard=k, each shard in about ``files`` files, and read the result back.

    Rows of a shard are dealt over its files by a number of their own, so that many rows of one key don't meet in one task.
    """
    walk = docs.withColumn("_shard", jump_walk(F.xxhash64(key), shards)["shard"].cast("int"))
    dealt = materialize(walk, "shard-rows").withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.repartition(max(shards * files, 1), "_shard", "_file").drop("_file").write.partitionBy("_shard").parquet(path)
    return docs.sparkSession.read.schema(walk.schema).parquet(path)
