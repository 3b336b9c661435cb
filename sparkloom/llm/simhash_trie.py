"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

1. Each text becomes a 64-bit fingerprint (3-word shingles, XXH64 with seed 42); equal
   fingerprints are one class from here on.
2. The trie's upper levels are walked in Spark: a table of node pairs, with the differing bits
   of their prefixes, is expanded level by level. A pair is dropped when its bits exceed the
   budget, and expanded further while one of its nodes holds more than ``cap`` fingerprints.
3. Fingerprints join the node pairs that they belong to: a node's task has its own fingerprints once
   and those of each partner above it. It walks them down the rest of the trie and emits a spanning
   forest of the links (fewer edges than fingerprints).
4. Connected components of the forest give each class its component.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows
share a class; rows without doc_id take part but name no component (component_id is null if no
member has an id); an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import components

BITS = 64
STEP = 2
CAP = 8192
#: Node pairs that are walked at once: some 10 MB of indices.
PIECE = 20_000
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the values that differ in at most ``budget`` bits.

    left, right: sorted distinct uint64, each below one trie node; right None: left with itself
    (each pair once). Walks node pairs level by level; the frontier holds pairs within the budget only.
    """
    one = right is None
    right = left if one else right
    # A frontier of node pairs: bounds in left and right. Nodes split on the next bit.
    frontier = [(np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]))] if len(left) and len(right) else []
    found_a, found_b = [], []
    while frontier:
        a0, a1, b0, b1 = frontier.pop()
        small = (a1 - a0) * (b1 - b0) <= 16
        if small.any():  # few leaves below: compare them all
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            sizes = (s1 - s0) * (t1 - t0)
            pair = np.repeat(np.arange(len(sizes)), sizes)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = s0[pair] + inner // (t1 - t0)[pair], t0[pair] + inner % (t1 - t0)[pair]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if one:
                near &= i < j
            found_a.append(i[near])
            found_b.append(j[near])
        a0, a1, b0, b1 = (x[~small] for x in (a0, a1, b0, b1))
        if not len(a0):
            continue
        # one step down: each node splits at its highest bit that is not shared by its whole range
        top = np.maximum(left[a0] ^ left[a1 - 1], right[b0] ^ right[b1 - 1])
        bit = np.uint64(63) - _leading_zeros(top)
        am, bm = _split(left, a0, a1, bit), _split(right, b0, b1, bit)
        kids = []
        for x0, x1 in ((a0, am), (am, a1)):
            for y0, y1 in ((b0, bm), (bm, b1)):
                kids.append((x0, x1, y0, y1))
        a0, a1, b0, b1 = (np.concatenate([k[n] for k in kids]) for n in range(4))
        shift = np.concatenate([bit] * 4)
        live = (a0 < a1) & (b0 < b1)
        if one:
            live &= ~(a0 > b0)  # the mirror image of a pair that is walked anyway
        a0, a1, b0, b1, shift = (x[live] for x in (a0, a1, b0, b1, shift))
        differing = np.bitwise_count((left[a0] ^ right[b0]) >> shift)
        live = differing <= budget
        a0, a1, b0, b1 = (x[live] for x in (a0, a1, b0, b1))
        for at in range(0, len(a0), PIECE):  # bounded pieces, depth first
            frontier.append(tuple(x[at : at + PIECE] for x in (a0, a1, b0, b1)))
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of uint64 values that are not zero."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return np.uint64(64) - np.bitwise_count(x).astype(np.uint64)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First index in [lo, hi) whose value has ``bit`` set, else hi; the values above that bit are equal in the range."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        is_set = (values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)
    return lo


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1 with the edges (a[i], b[i])."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _walk(budget: int):
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy().view(np.uint64)
        right_side = group["right_side"].to_numpy()
        left, right = np.sort(values[~right_side]), np.sort(values[right_side])
        a, b = trie_links(left, right, budget)
        b = b + len(left)
        if group["one"].any():  # the node with itself
            inner_a, inner_b = trie_links(left, None, budget)
            a, b = np.concatenate([a, inner_a]), np.concatenate([b, inner_b])
        every = np.concatenate([left, right])
        edges = forest(a, b, len(every))
        x = np.array([i for i, _ in edges], dtype=np.int64)
        y = np.array([j for _, j in edges], dtype=np.int64)
        return pd.DataFrame({"a": every[x].view(np.int64), "b": every[y].view(np.int64)})

    return walk


def _node(fp: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), BITS - depth) if depth else F.lit(0).cast("long")


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def expand_pairs(at_x: np.ndarray, n_x: np.ndarray, at_y: np.ndarray, n_y: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the blocks [at_x, at_x + n_x) x [at_y, at_y + n_y), in pieces of bounded size (a larger block comes in rows)."""
    big = n_x * n_y > most
    for k in np.flatnonzero(big):
        step = max(1, most // int(n_y[k]))
        for i in range(int(at_x[k]), int(at_x[k] + n_x[k]), step):
            own = np.arange(i, min(i + step, int(at_x[k] + n_x[k])))
            yield np.repeat(own, n_y[k]), np.tile(np.arange(at_y[k], at_y[k] + n_y[k]), len(own))
    at_x, n_x, at_y, n_y = (v[~big] for v in (at_x, n_x, at_y, n_y))
    sizes = n_x * n_y
    piece = np.cumsum(sizes) // most
    for number in np.unique(piece):
        own = piece == number
        pair = np.repeat(np.flatnonzero(own), sizes[own])
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        yield at_x[pair] + inner // n_y[pair], at_y[pair] + inner % n_y[pair]


def node_pairs(fps: DataFrame, budget: int, cap: int, depth: int = 0) -> list[tuple[int, DataFrame]]:
    """The walk of the upper trie from the nodes at ``depth``: (depth, pairs of nodes a <= b there within the budget) for the tasks below."""
    work = []
    pairs = fps.groupBy(_node("fp", depth).alias("a")).agg(F.count(F.lit(1)).alias("na")).select("a", F.col("a").alias("b"), F.lit(0).alias("bits"), "na", F.col("na").alias("nb"))
    while True:
        heavy = (F.greatest("na", "nb") > cap) & F.lit(depth < BITS - STEP)
        pairs = materialize(pairs, "trie")
        work.append((depth, pairs.filter(~heavy).select("a", "b")))
        deeper = pairs.filter(heavy)
        if deeper.isEmpty():
            return work
        depth += STEP
        nodes = fps.groupBy(_node("fp", depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        nodes = nodes.withColumn("up", F.shiftrightunsigned("node", STEP))
        x = nodes.select(F.col("up").alias("a"), F.col("node").alias("ka"), F.col("n").alias("na"))
        y = nodes.select(F.col("up").alias("b"), F.col("node").alias("kb"), F.col("n").alias("nb"))
        more = F.bit_count(F.col("ka").bitwiseXOR(F.col("kb")).bitwiseAND(F.lit((1 << STEP) - 1)))
        pairs = (
            deeper.select("a", "b", "bits").join(x, "a").join(y, "b")
            .withColumn("bits", (F.col("bits") + more).cast("int"))
            .filter((F.col("bits") <= budget) & (F.col("ka") <= F.col("kb")))
            .select(F.col("ka").alias("a"), F.col("kb").alias("b"), "bits", "na", "nb")
        )


def deal(rows: DataFrame, budget: int, cap: int, depth: int = 0) -> GroupedData:
    """``rows`` (fp, ...) grouped into tasks: those of one trie node, once, and those of its partners within the budget (right_side).

    ``one`` is true on a node's own rows if the node is to be joined with itself too.
    """
    dealt = None
    for at, pairs in node_pairs(rows.select("fp").distinct(), budget, cap, depth):
        left = pairs.groupBy("a").agg(F.max(F.col("a") == F.col("b")).alias("one")).select("a", "one", F.lit(False).alias("right_side"), F.col("a").alias("node"))
        right = pairs.filter("a <> b").select("a", F.lit(False).alias("one"), F.lit(True).alias("right_side"), F.col("b").alias("node"))
        own = rows.withColumn("node", _node("fp", at)).join(left.unionByName(right), "node").drop("node").withColumn("depth", F.lit(at))
        dealt = own if dealt is None else dealt.unionByName(own)
    return dealt.groupBy("depth", "a")


def fingerprint_links(fps: DataFrame, budget: int = 2, cap: int = CAP) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in ``fps`` (fp) whose components are those of all links."""
    return deal(fps.select("fp"), budget, cap).applyInPandas(_walk(budget), "a long, b long")


def simhash_components(docs: DataFrame, budget: int = 2, cap: int = CAP) -> DataFrame:
    """doc_id, fp (long), component_id for each row of ``docs`` (doc_id, text)."""
    return _labelled(materialize(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "simhash"), budget, cap).drop("keep")


def _labelled(prints: DataFrame, budget: int, cap: int) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with component_id, and keep: (doc_id, row_hash) of the component's first row with an id, where there is a row_hash."""
    row = F.struct("doc_id", "row_hash") if "row_hash" in prints.columns else F.struct("doc_id")
    classes = prints.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("low"))
    links = materialize(fingerprint_links(classes.select("fp"), budget, cap), "simhash-links")
    labelled = classes.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("low").alias("keep"))
    by_print = materialize(labelled.join(least, "root").select("fp", "keep", F.col("keep.doc_id").alias("component_id")), "simhash-labels")
    return prints.join(by_print, "fp")


def keep_one(docs: DataFrame, budget: int = 2) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest (doc_id, row hash), once.

    Rows of one doc_id with different texts are told apart by a hash of the row. Rows without doc_id
    can't be told apart by name and stay.
    """
    rows = materialize(docs.select("doc_id", F.xxhash64(*docs.columns).alias("row_hash"), fingerprint_udf("text").alias("fp")), "simhash")
    keepers = _labelled(rows, budget, CAP).filter(F.struct("doc_id", "row_hash") == F.col("keep")).select("doc_id", F.col("row_hash").alias("_st_hash")).distinct()
    named = docs.filter("doc_id is not null").withColumn("_st_hash", F.xxhash64(*docs.columns))
    named = named.join(keepers.hint("merge"), ["doc_id", "_st_hash"], "left_semi").dropDuplicates(["doc_id", "_st_hash"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))
