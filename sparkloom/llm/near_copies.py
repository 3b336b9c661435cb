"""Near copies by the trie join, for texts whose 5-word shingles have a Jaccard of at least 0.8.

One SimHash of 64 bits is too coarse for that similarity: two such texts differ in ten bits of it on average. So the
trie of ``simhash_trie`` is joined with many short prints at once.

1. Each text becomes the set of its 5-word shingles (XXH64); texts with equal sets are one class from here on.
2. A class has ``TABLES`` prints of ``PRINT`` bits, each the SimHash of the set under a hash family of its own, and one
   ``check`` print of 64 bits. All prints lie in one trie: before its bits a print has its table's number, written
   BUDGET + 1 times, so prints of different tables never come within the budget.
3. Classes with an equal print meet the smallest of them; each is compared with the nearest one it met. Components of
   the confirmed links make large groups of near copies one root before any pairs are listed.
4. The trie join walks node pairs within BUDGET differing bits and yields pairs of (print, root) with different roots.
   They are spelled out as pairs of classes; those whose check prints differ in more than ``CHECK_BITS`` are no near copies.
5. Of each pair of roots the nearest pair of classes is compared first; then all pairs that still lie in different components.

A link counts only if the exact Jaccard of the two sets is at least 4/5. By calculation a pair at 0.8 shares a print within the
budget with 97.5 %, at 0.85 with 99.8 %, at 0.9 with more than 99.99 %; the tests measure it.

Defined cases: null and empty texts have no shingles and are one class; texts of fewer than five words are one shingle; sets of
fewer than ``SMALL`` shingles are near copies only of equal sets; rows without doc_id can't be told apart by name and stay; an
empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import components
from .simhash_trie import deal, expand_pairs, hamming, trie_links

SHINGLE = 5
SEED = 42
#: The Jaccard that makes two texts near copies, as a fraction.
LEAST = (4, 5)
#: Below this size a set reaches the Jaccard only with an equal one.
SMALL = 4
TABLES, PRINT, BUDGET = 30, 32, 2
#: Check prints of two texts at the Jaccard differ in 10 bits on average (deviation 3), those of unrelated texts in 32 (deviation 4).
CHECK_BITS = 20
CAP = 262_144
_NUMBER = 5  # bits of a table's number
_CODE = _NUMBER * (BUDGET + 1)
_WORDS = (TABLES * PRINT + 64) // 64
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PREFIX = np.array([sum(t << (_NUMBER * k) for k in range(BUDGET + 1)) for t in range(TABLES)], dtype=np.uint64) << np.uint64(64 - _CODE)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct uint64 hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], dtype=np.uint64))


def prints(own: np.ndarray) -> tuple[np.ndarray, int]:
    """The prints of a set of shingles as values of the one trie, and its check print."""
    ones = np.zeros(_WORDS * 64, dtype=np.int64)
    for at in range(0, len(own), 255):  # so many ones fit a byte
        x = own[at : at + 255, None] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    bits = np.packbits(2 * ones > len(own))
    short = bits[: TABLES * PRINT // 8].view(">u4").astype(np.uint64)
    return _PREFIX | short << np.uint64(64 - _CODE - PRINT), int(bits[-8:].view(">i8")[0])


@F.pandas_udf(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("check", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType()))]))
def _sketch(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        own = shingles(text)
        key = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], dtype=np.uint64).view(np.int64)[0] if len(own) else 0
        found, check = prints(own) if len(own) >= SMALL else (np.zeros(0, dtype=np.uint64), 0)
        out.append((int(key), len(own), check, found.view(np.int64)))
    return pd.DataFrame(out, columns=["key", "n", "check", "prints"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def _confirmed(pairs: DataFrame, classes: DataFrame, hashed: DataFrame) -> DataFrame:
    """The pairs (a, b) of class keys whose sets reach the Jaccard. One row of each class gives its set."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = keys.join(classes, "key").select("key", F.coalesce("low", "any").alias("row")).select("key", F.col("row.doc_id").alias("_id"), F.col("row.row_hash").alias("row_hash"))
    # Written, so its size is known: Spark broadcasts it only below its own bound.
    wanted = materialize(wanted, "near-wanted")
    found = hashed.join(wanted, "row_hash").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", _set("text").alias("own"))
    sets = materialize(found.dropDuplicates(["key"]), "near-sets")
    x, y = sets.select(F.col("key").alias("a"), F.col("own").alias("xs")), sets.select(F.col("key").alias("b"), F.col("own").alias("ys"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    shared = F.size(F.array_intersect("xs", "ys"))
    return both.filter(shared * (LEAST[0] + LEAST[1]) >= LEAST[0] * (F.size("xs") + F.size("ys"))).select("a", "b")


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of (print, root) of different roots within the budget: of a node with itself and with its partners."""
    right_side = group["right_side"].to_numpy()
    fp, root = group["fp"].to_numpy().view(np.uint64), group["root"].to_numpy()
    order = [np.lexsort((root[s], fp[s])) for s in (~right_side, right_side)]
    left, right = ((fp[s][o], root[s][o]) for s, o in zip((~right_side, right_side), order, strict=True))
    jobs = [(left, None)] if group["one"].any() else []
    if len(right[0]):
        jobs.append((left, right))
    out = []
    for x, y in jobs:
        values_x, at_x, n_x = np.unique(x[0], return_index=True, return_counts=True)
        values_y, at_y, n_y = np.unique(y[0], return_index=True, return_counts=True) if y else (values_x, at_x, n_x)
        a, b = trie_links(values_x, values_y if y else None, BUDGET)
        if not y:  # prints of one value with different roots
            several = np.flatnonzero(n_x > 1)
            a, b = np.concatenate([a, several]), np.concatenate([b, several])
        y = y or x
        for i, j in expand_pairs(at_x[a], n_x[a], at_y[b], n_y[b]):
            live = x[1][i] != y[1][j]
            i, j = i[live], j[live]
            out.append(pd.DataFrame({"fp_x": x[0][i].view(np.int64), "root_x": x[1][i], "fp_y": y[0][j].view(np.int64), "root_y": y[1][j]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("fp_x", "root_x", "fp_y", "root_y")})


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _roots(links: DataFrame) -> DataFrame:
    return components(links).withColumnRenamed("node", "key")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components, with those as root_a and root_b."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("key").alias(side), F.col("root").alias(f"root_{side}")).hint("merge"), side, "left")
        pairs = pairs.withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.filter("root_a <> root_b")


def candidates(dealt: DataFrame, roots: DataFrame, cap: int = CAP) -> DataFrame:
    """Pairs (a, b, bits) of classes of different roots that are near in a table and by their check prints."""
    placed = materialize(dealt.join(roots.hint("merge"), "key", "left").select("fp", F.coalesce("root", "key").alias("root"), "key", "check"), "near-placed")
    parts = placed.select("fp", "root").distinct()
    near = materialize(deal(parts, BUDGET, cap, _CODE).applyInPandas(_walk, "fp_x long, root_x long, fp_y long, root_y long"), "near-parts")
    x, y = (placed.select(F.col("fp").alias(f"fp_{s}"), F.col("root").alias(f"root_{s}"), F.col("key").alias(f"key_{s}"), F.col("check").alias(f"check_{s}")) for s in "xy")
    spelled = near.join(x.hint("merge"), ["fp_x", "root_x"]).join(y.hint("merge"), ["fp_y", "root_y"])
    bits = hamming(F.col("check_x"), F.col("check_y")).alias("bits")
    return spelled.select(*_pair("key_x", "key_y"), bits).filter(F.col("bits") <= CHECK_BITS).distinct()


def near_components(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, row_hash, keep for each row of ``docs`` (doc_id, text, ...): keep is (doc_id, row_hash) of the smallest row with an id of its component."""
    hashed = docs.select("doc_id", "text", F.xxhash64(*docs.columns).alias("row_hash"))
    rows = materialize(hashed.select("doc_id", "row_hash", _sketch("text").alias("s")).select("doc_id", "row_hash", "s.*"), "near-rows")
    row = F.struct("doc_id", "row_hash")
    low = [F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("low"), F.min(row).alias("any")]
    classes = materialize(rows.groupBy("key").agg(*low, *[F.first(c).alias(c) for c in ("check", "prints")]), "near-classes")
    dealt = classes.select("key", "check", F.explode("prints").alias("fp"))

    # each class and the nearest of those that are smallest under one of its prints
    shared = dealt.groupBy("fp").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("key", "check")).alias("first")).filter("size > 1").select("fp", "first")
    met = dealt.join(shared.hint("merge"), "fp").filter("key <> first.key")
    nearest = met.groupBy("key").agg(F.min(F.struct(hamming(F.col("check"), F.col("first.check")).alias("bits"), F.col("first.key").alias("other"))).alias("at"))
    stars = materialize(nearest.filter(F.col("at.bits") <= CHECK_BITS).select(*_pair("key", "at.other")).distinct(), "near-stars")
    links = materialize(_confirmed(stars, classes, hashed), "near-links")

    roots = _roots(links)
    pairs = materialize(candidates(dealt, roots, cap).join(stars, ["a", "b"], "left_anti"), "near-candidates")
    nearest_first = _across(pairs, roots).groupBy(F.least("root_a", "root_b").alias("r"), F.greatest("root_a", "root_b").alias("s")).agg(F.min(F.struct("bits", "a", "b")).alias("at"))
    first = materialize(nearest_first.select("at.a", "at.b"), "near-first")
    links = links.unionByName(materialize(_confirmed(first, classes, hashed), "near-links"))
    rest = materialize(_across(pairs, _roots(links)).select("a", "b").join(first, ["a", "b"], "left_anti"), "near-rest")
    links = links.unionByName(materialize(_confirmed(rest, classes, hashed), "near-links"))

    labelled = classes.join(_roots(links).hint("merge"), "key", "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    least = labelled.groupBy("root").agg(F.min("low").alias("keep"))
    by_key = materialize(labelled.join(least, "root").select("key", "keep"), "near-labels")
    return rows.select("doc_id", "row_hash", "key").join(by_key.hint("merge"), "key").select("doc_id", "row_hash", "keep")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns: that with the smallest (doc_id, row hash), once. Rows without doc_id stay."""
    keepers = near_components(docs).filter(F.struct("doc_id", "row_hash") == F.col("keep")).select("doc_id", F.col("row_hash").alias("_nc_hash")).distinct()
    named = docs.filter("doc_id is not null").withColumn("_nc_hash", F.xxhash64(*docs.columns))
    named = named.join(keepers.hint("merge"), ["doc_id", "_nc_hash"], "left_semi").dropDuplicates(["doc_id", "_nc_hash"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))
