"""A Merkle manifest of a table: one tree of rows for each part, one tree of the parts' roots above them.

A tree is reduced by superblocks. Nodes are bucketed by their index over fanout^k; a task gets one bucket at a time, of 4,096
nodes at most, and collapses k levels of it; the buckets' roots are the nodes of the next pass, until one node
of each tree is left. Proofs go the other way: a bucket gets the one proof of its root and appends it to the proofs of its
nodes inside the bucket. So a pass over the rows shuffles digests, never proofs, and no group grows with the table.

A proof is the siblings' digests of 32 bytes, from the row up and from left to right, with two numbers for each level:
the node's place in its run and the run's size. A run of one node has no siblings but is hashed as well.

Defined cases: a null field is a dash; parts and rows with null keys come first; rows that tie on the key are ordered by their digest,
and equal ones are interchangeable; a part with one row has that row's digest as its root; an empty table gives no rows. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import attach, materialize
from .numbering import ranked

FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "_proof binary, _places array<int>, _runs array<int>, _subroot binary, _root binary"


def field(c: Column) -> Column:
    """Byte count, colon, value; a dash for null."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's fields, as 32 bytes; ``text`` stands for the text column."""
    return F.unhex(F.sha2(F.concat(*[field(F.col(f) if f != "text" or text is None else text) for f in FIELDS]), 256))


def _hash(run: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


def height(n: int, fanout: int) -> int:
    """Levels until one of ``n`` nodes is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _levels(digests: list[bytes], n: int, fanout: int, most: int) -> list[list[bytes]]:
    """The nodes of a bucket, level by level; ``n`` nodes in the whole tree say how many levels there are."""
    out = [digests]
    for _ in range(min(most, height(n, fanout))):
        below = out[-1]
        out.append([_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def _bucket(span: int) -> Column:
    return F.expr(f"_i div {span}")


def _collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(_tree, _i, _n, _digest): the roots of the buckets."""
    span = fanout**levels

    def roots(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i")
        n = int(group["_n"].iloc[0])
        top = _levels(list(group["_digest"]), n, fanout, levels)[-1]
        return pd.DataFrame({"_tree": [key[0]], "_i": [key[1]], "_n": [-(-n // span)], "_digest": top})

    slim = nodes.select("_tree", "_i", "_n", "_digest").withColumn("_bucket", _bucket(span))
    return slim.groupBy("_tree", "_bucket").applyInPandas(roots, "_tree long, _i long, _n long, _digest binary")


def _passes(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their buckets, the roots of those, until each tree has one node: one pass for each factor of fanout^levels."""
    out = [nodes]
    while True:
        out.append(materialize(_collapsed(out[-1], fanout, levels), "merkle"))
        if (out[-1].agg(F.max("_n")).first()[0] or 0) <= 1:
            return out


def _with_proofs(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with their proofs: those inside their bucket, then the proof of the bucket's root in ``above`` (_tree, _i, proof)."""
    span = fanout**levels
    columns = nodes.columns

    def extend(group: pd.DataFrame, root: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i")
        up = root.iloc[0]
        tail, places, runs = bytes(up["_proof"]), list(up["_places"]), list(up["_runs"])
        tree = _levels(list(group["_digest"]), int(group["_n"].iloc[0]), fanout, levels)
        proofs, at, sizes = [], [], []
        for i in range(len(group)):
            parts, own, size, k = [], [], [], i
            for nodes_ in tree[:-1]:
                begin = k - k % fanout
                run = nodes_[begin : begin + fanout]
                parts += run[: k - begin] + run[k - begin + 1 :]
                own.append(k - begin)
                size.append(len(run))
                k //= fanout
            proofs.append(b"".join(parts) + tail)
            at.append(own + places)
            sizes.append(size + runs)
        found = group[columns].copy()
        found["_proof"], found["_places"], found["_runs"] = proofs, at, sizes
        found["_subroot"], found["_root"] = [up["_subroot"]] * len(group), [up["_root"]] * len(group)
        return found

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    left = nodes.withColumn("_bucket", _bucket(span)).groupBy("_tree", "_bucket")
    right = above.select("_tree", F.col("_i").alias("_bucket"), "_proof", "_places", "_runs", "_subroot", "_root").groupBy("_tree", "_bucket")
    return left.cogroup(right).applyInPandas(extend, f"{kinds}, {_PROOF}")


def _down(passes: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The nodes of the first pass with their proofs, given those of the last; what lies between is written, being fanout^levels times smaller."""
    known = top
    for nodes in passes[-2:0:-1]:
        known = materialize(_with_proofs(nodes, known, fanout, levels), "merkle-proofs")
    return _with_proofs(passes[0], known, fanout, levels)


def manifest(docs: DataFrame, claimed: Column | None = None, part: str = "lang", key: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(part, key, index, leaf, claim, subroot, root, proof, places, runs) for each row of ``docs``; digests are 32 bytes.

    ``claimed``: what is presented as a row's text when it is audited; claim is the digest with it, null where it is null.
    """
    claim = F.when(claimed.isNotNull(), leaf(claimed)) if claimed is not None else F.lit(None).cast("binary")
    rows = docs.select(F.col(part).alias("_part_key"), F.col(key).alias("_key"), leaf().alias("_digest"), claim.alias("_claim"))
    order = ranked(rows, ["_part_key", "_key", "_digest"], "merkle-leaves")
    parts = order.groupBy("_part_key").agg(F.min("_rank").alias("_tree"), F.count(F.lit(1)).alias("_n"))
    placed = attach(order, parts, "_part_key", F.col("_rank"))
    leaves = materialize(placed.select("_part_key", "_key", "_claim", "_tree", (F.col("_rank") - F.col("_tree")).alias("_i"), "_n", "_digest"), "merkle")

    lower = _passes(leaves, fanout, levels)
    subroots = ranked(lower[-1].select(F.col("_tree").alias("_of"), "_digest"), ["_of"], "merkle-subroots")
    n = subroots.count()
    tops = subroots.select("_of", F.lit(0).cast("long").alias("_tree"), F.col("_rank").alias("_i"), F.lit(n).cast("long").alias("_n"), "_digest")
    upper = _passes(tops, fanout, levels)
    none = F.array().cast("array<int>")
    root = upper[-1].select("_tree", "_i", F.lit(b"").alias("_proof"), none.alias("_places"), none.alias("_runs"), F.lit(None).cast("binary").alias("_subroot"), F.col("_digest").alias("_root"))
    above = _down(upper, root, fanout, levels)
    known = above.select(F.col("_of").alias("_tree"), F.lit(0).cast("long").alias("_i"), "_proof", "_places", "_runs", F.col("_digest").alias("_subroot"), "_root")
    out = _down(lower, materialize(known, "merkle-proofs"), fanout, levels)
    return out.select(
        F.col("_part_key").alias("part"), F.col("_key").alias("key"), F.col("_i").alias("index"), F.col("_digest").alias("leaf"), F.col("_claim").alias("claim"),
        F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof"), F.col("_places").alias("places"), F.col("_runs").alias("runs"),
    )


def fold(digest: bytes, proof: bytes, places: Iterable[int], runs: Iterable[int]) -> bytes:
    """The root that ``digest`` and its proof lead to."""
    at = 0
    for place, size in zip(places, runs):
        others = [proof[at + 32 * k : at + 32 * (k + 1)] for k in range(size - 1)]
        at += 32 * (size - 1)
        digest = _hash([*others[:place], digest, *others[place:]])
    return digest


@F.pandas_udf(BinaryType())
def folded(digest: pd.Series, proof: pd.Series, places: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([fold(bytes(d), bytes(p), np.asarray(a).tolist(), np.asarray(r).tolist()) for d, p, a, r in zip(digest, proof, places, runs)], dtype=object)


def hexed(c: str) -> Column:
    return F.lower(F.hex(c))
