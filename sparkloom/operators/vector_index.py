"""A vector index kept as files: inverted lists of cells, product-quantised codes, exact re-ranking.

``build`` trains about sqrt(n) cell centres (k-means of Spark's ML library on a stated sample) and, for each slice of the
residuals, 256 code words; then every vector is put in its nearest cell with a code of one byte a slice. The lists are
partitioned by cell, so a search reads the files of the cells it probes and no others, and of those only ids and codes;
the vectors themselves are read for the short list alone.

How many cells to probe and how long the short list must be is measured when the index is built: a bounded number of its own vectors
are searched exactly, and both are set so that the wanted recall is kept on them. On data without clusters that is most of the cells.

Defined cases: vectors that are null, of zero length or not of the index's dimension are not indexed and find nothing; equal vectors are ranked by
id; an empty table gives an empty index that finds nothing. Other columns of the table are kept with the vectors and may be filtered on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import new_path
from .graph import cut
from .vector import cosine, norm

#: Bounds of what is trained and of what the driver and each task hold: cells, vectors that train a cell, vectors that train the codes,
#: vectors the search is tuned on.
MAX_CELLS, PER_CELL, CODE_SAMPLE, TUNE = 16_384, 64, 20_000, 256
WORDS = 256
#: Rows of a list, and queries, that meet in one task, and of those the queries that are scored at once.
LIST_ROWS, QUERY_ROWS, AT_ONCE = 16_384, 8192, 256
#: Queries times cells that a task chooses among at a time, each of which may be a row with the query's vector.
PROBED_ROWS = 65_536
#: Steps of the approximate cosine that a unit is cut into, for counting.
STEPS = 128
_META = ("cell", "vec_id", "code", "v")


@dataclass(frozen=True)
class Index:
    path: str
    dim: int
    cells: int
    pieces: int
    rows: int
    probes: int
    shortlist: int
    scanned: float  # mean share of the rows that the tuning queries' cells hold
    columns: str  # of the lists, as DDL


@dataclass(frozen=True)
class _Books:
    """What a task needs to code and to search: centres (cells, dim) and code words (pieces, words, dim / pieces)."""

    centres: np.ndarray
    words: np.ndarray

    def slices(self, m: np.ndarray) -> np.ndarray:
        pieces, _, width = self.words.shape
        out = np.zeros((len(m), pieces * width), dtype=np.float32)
        out[:, : m.shape[1]] = m
        return out.reshape(len(m), pieces, width)

    def nearest(self, m: np.ndarray) -> np.ndarray:
        return np.argmax(m @ self.centres.T, axis=1)

    def codes(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self.slices(m - self.centres[cell])
        out = np.zeros(rest.shape[:2], dtype=np.uint8)
        for p, words in enumerate(self.words):
            out[:, p] = np.argmin((words**2).sum(1) - 2 * rest[:, p] @ words.T, axis=1)
        return out

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What cells and codes stand for, (rows, dim). Queries times these are approximate cosines: one product is faster than a table for each slice."""
        rest = np.concatenate([words[codes[:, p]] for p, words in enumerate(self.words)], axis=1)
        return self.centres[cell] + rest[:, : self.centres.shape[1]]


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _sample(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of ``n`` rows, chosen by id hash."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)) < most)


def _centres(rows: DataFrame, cells: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=cells, maxIter=8, initSteps=1, seed=seed, distanceMeasure="cosine", featuresCol="x").fit(rows.select(array_to_vector("v").alias("x")))
    return np.array(model.clusterCenters(), dtype=np.float32)


def _lloyd(m: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Code words of one slice, by plain k-means over a bounded sample."""
    words = m[np.linspace(0, len(m) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmin((words**2).sum(1) - 2 * m @ words.T, axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, own, m)
        n = np.bincount(own, minlength=k)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def _words(rows: DataFrame, centres: np.ndarray, pieces: int) -> np.ndarray:
    """(pieces, words, width): each slice is trained in a task of its own."""
    dim = centres.shape[1]
    width = -(-dim // pieces)
    empty = _Books(centres, np.zeros((pieces, 1, width), dtype=np.float32))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = _unit(f["v"])
                rest = empty.slices(m - centres[empty.nearest(m)])
                yield pd.DataFrame({"piece": np.tile(np.arange(pieces), len(m)), "vec_id": np.repeat(f["vec_id"].to_numpy(), pieces), "x": list(rest.reshape(-1, width))})

    def train(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(group.sort_values("vec_id")["x"].to_numpy()).astype(np.float32)
        found = _lloyd(m, min(WORDS, len(m)))
        return pd.DataFrame({"piece": key[0], "word": np.arange(len(found)), "x": list(found)})

    split = rows.select("vec_id", "v").mapInPandas(parts, "piece int, vec_id long, x array<float>")
    found = split.groupBy("piece").applyInPandas(train, "piece int, word int, x array<float>").toPandas()  # pieces * 256 short rows
    size = int(found["word"].max()) + 1
    out = np.full((pieces, size, width), 1e3, dtype=np.float32)
    out[found["piece"], found["word"]] = np.stack(found["x"].to_numpy())
    return out


def _coded(vectors: DataFrame, books: _Books) -> DataFrame:
    """``vectors`` with cell, code and the angle to the cell's centre."""

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = _unit(f["v"])
                cell = books.nearest(m)
                centre = books.centres[cell]
                cos = (m * centre).sum(1) / np.maximum(np.linalg.norm(centre, axis=1), 1e-30)
                f = f.assign(cell=cell.astype(np.int32), code=[c.tobytes() for c in books.codes(m, cell)], angle=np.arccos(np.clip(cos, -1, 1)).astype(float))
            else:
                f = f.assign(cell=pd.Series(dtype="int32"), code=pd.Series(dtype=object), angle=pd.Series(dtype=float))
            yield f

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInPandas(code, f"{kinds}, cell int, code binary, angle double")


def _fit_rows(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.filter((F.size("v") == dim) & (norm(F.col("v")) > 0))


def _store(coded: DataFrame, path: str) -> None:
    """Append to the lists; a crowded cell is written by several tasks."""
    parts = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("_parts"))  # a row for each cell
    dealt = coded.join(F.broadcast(parts), "cell").withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")))
    dealt.repartition("cell", "_part").drop("_part", "_parts", "angle").write.mode("append").partitionBy("cell").parquet(f"{path}/lists")
    coded.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("append").parquet(f"{path}/sizes")


def _save(spark: SparkSession, name: str, m: np.ndarray, path: str) -> None:
    flat = m.reshape(-1, m.shape[-1])
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(flat)], "at int, x array<float>").coalesce(1).write.parquet(f"{path}/{name}")


def _load(spark: SparkSession, index: Index) -> _Books:
    def read(name: str) -> np.ndarray:
        return np.array([r["x"] for r in spark.read.parquet(f"{index.path}/{name}").orderBy("at").collect()], dtype=np.float32)

    words = read("words")
    return _Books(read("centres"), words.reshape(index.pieces, -1, words.shape[-1]))


def _top(df: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` best rows of each query, ties by id."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id"))).filter(F.col("rank") <= most)


def _tuned(rows: DataFrame, lists: DataFrame, books: _Books, k: int, recall: float) -> tuple[int, int, float]:
    """Probes, length of the short list and share of rows scanned, so that of the true ``k`` nearest of TUNE vectors about ``recall`` are found.

    Each of the two steps may lose half of what may be lost. The driver holds TUNE queries and k ids for each.
    """
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(77)), "vec_id").limit(TUNE).select("vec_id", "v").toPandas()
    if not len(chosen):
        return 1, k, 1.0
    q, ids = _unit(chosen["v"]), chosen["vec_id"].to_numpy()

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                sims = q @ _unit(f["v"]).T
                sims[ids[:, None] == f["vec_id"].to_numpy()[None, :]] = -2
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                codes = np.array(f["code"].tolist(), dtype=object)
                yield pd.DataFrame({"query_id": np.repeat(np.arange(len(q)), best.shape[1]), "vec_id": f["vec_id"].to_numpy()[best.ravel()], "cell": f["cell"].to_numpy()[best.ravel()], "code": codes[best.ravel()], "s": np.take_along_axis(sims, best, 1).ravel().astype(float)})

    found = lists.select(*_META).mapInPandas(exact, "query_id int, vec_id long, cell int, code binary, s double")
    true = _top(found.filter("s > -2"), "s", k).toPandas()
    if not len(true):
        return 1, k, 1.0
    order = np.argsort(-(q @ books.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[true["query_id"], true["cell"]]
    step = 1 - (1 - recall) / 2
    probes = int(np.quantile(place, step, method="higher")) + 1

    codes = np.frombuffer(b"".join(true["code"]), dtype=np.uint8).reshape(len(true), -1)
    mine = (q[true["query_id"]] * books.decoded(true["cell"].to_numpy(), codes)).sum(1)
    probed = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(probed, order[:, :probes], True, 1)

    def ahead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        better, scanned = np.zeros(len(true), dtype=np.int64), 0
        for f in frames:
            if len(f):
                cell = f["cell"].to_numpy()
                scores = q @ books.decoded(cell, np.frombuffer(b"".join(f["code"]), dtype=np.uint8).reshape(len(f), -1)).T
                scores[~probed[:, cell]] = -np.inf
                scanned += int(np.isfinite(scores).sum())
                scores.sort(axis=1)
                for r, at in true.groupby("query_id").groups.items():
                    better[at] += scores.shape[1] - np.searchsorted(scores[r], mine[at], side="right")
        yield pd.DataFrame({"at": np.arange(len(true)), "better": better, "scanned": scanned})

    counts = lists.select("cell", "code").mapInPandas(ahead, "at long, better long, scanned long").groupBy("at").agg(F.sum("better").alias("better"), F.sum("scanned").alias("scanned")).toPandas()
    depth = int(np.quantile(counts["better"], step, method="higher")) + 2  # a query that is no vector of the index has no self among its best
    total = int(lists.count())
    return probes, max(k, depth), float(counts["scanned"].iloc[0]) / (len(q) * total)


def build(vectors: DataFrame, path: str | None = None, pieces: int = 16, cells: int | None = None, k: int = 10, recall: float = 0.95, seed: int = 11) -> Index:
    """Index ``vectors`` (vec_id, v and any other columns) below ``path``, tuned for the ``k`` nearest at ``recall``."""
    spark = vectors.sparkSession
    path = path or new_path(spark, "vector-index")
    vectors = cut(vectors, "index-given")
    first = vectors.filter("v is not null and size(v) > 0").select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = first["n"] if first else 1
    rows = _fit_rows(vectors, dim)
    n = rows.count()
    pieces = min(pieces, dim)
    if n:
        cells = min(cells or max(1, round(math.sqrt(n))), MAX_CELLS, n)
        centres = _centres(_sample(rows, n, PER_CELL * cells, seed), cells, seed) if cells > 1 else np.zeros((1, dim), dtype=np.float32)
        books = _Books(centres, _words(_sample(rows, n, CODE_SAMPLE, seed + 1), centres, pieces))
    else:
        books = _Books(np.zeros((1, dim), dtype=np.float32), np.zeros((pieces, 1, -(-dim // pieces)), dtype=np.float32))
    _save(spark, "centres", books.centres, path)
    _save(spark, "words", books.words, path)
    _store(cut(_coded(rows, books), "index-coded"), path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", code binary, cell int"
    lists = spark.read.schema(columns).parquet(f"{path}/lists")
    probes, shortlist, scanned = _tuned(rows, lists, books, k, recall)
    index = Index(path, dim, len(books.centres), pieces, n, probes, shortlist, scanned, columns)
    spark.createDataFrame([(json.dumps(asdict(index)),)], "value string").coalesce(1).write.text(f"{path}/index.json")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(**json.loads(spark.read.text(f"{path}/index.json").first()["value"]))


def lists_of(spark: SparkSession, index: Index) -> DataFrame:
    return spark.read.schema(index.columns).parquet(f"{index.path}/lists")


def add(vectors: DataFrame, index: Index) -> None:
    """Append vectors with new ids, in the cells and code words that the index has. Columns as when it was built."""
    books = _load(vectors.sparkSession, index)
    _store(cut(_coded(_fit_rows(vectors, index.dim), books), "index-coded"), index.path)


def _probed(queries: DataFrame, index: Index, books: _Books, radius: np.ndarray | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, q, cell): each query's direction, in 16-bit numbers, with its nearest cells.

    With ``radius``: each query as it is, with all cells that may hold something at least as near as ``least``.
    """
    most = min(probes or index.probes, index.cells)
    lengths = np.maximum(np.linalg.norm(books.centres, axis=1), 1e-30)

    at_once = max(1, PROBED_ROWS // max(1, index.cells))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f.iloc[at : at + at_once] for f in frames for at in range(0, len(f), at_once)):
            q = _unit(f["q"])
            if radius is None:
                cells = np.argsort(-(q @ books.centres.T), axis=1, kind="stable")[:, :most]
                r, c = np.repeat(np.arange(len(q)), cells.shape[1]), cells.ravel()
            else:
                angle = np.arccos(np.clip(q @ (books.centres / lengths[:, None]).T, -1, 1))
                low = np.arccos(np.clip(f["least"].to_numpy(dtype=float) - 2e-6, -1, 1))
                r, c = np.nonzero(angle - radius[None, :] <= low[:, None] + 2e-3)  # angles are of 32-bit numbers
            given = f["q"].to_numpy() if radius is not None else np.array([x.tobytes() for x in q.astype(np.float16)] + [None], dtype=object)[:-1]
            yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[r], "q": given[r], "cell": c.astype(np.int32)})

    return queries.mapInPandas(choose, f"query_id long, q {'array<double>' if radius is not None else 'binary'}, cell int")


def _pruned(lists: DataFrame, probed: DataFrame, index: Index) -> DataFrame:
    """The lists of the probed cells only: a filter on the partition column, so other cells' files are not opened. The driver sees one number a cell."""
    wanted = sorted(r["cell"] for r in probed.select("cell").distinct().collect())
    return lists if len(wanted) == index.cells else lists.filter(F.col("cell").isin(wanted))


def step_counts(scores: np.ndarray) -> np.ndarray:
    """(queries, 8 * STEPS): how many scores of each query lie in each step from -4 on."""
    steps = np.floor(scores * STEPS).astype(np.intp) + (4 * STEPS + 8 * STEPS * np.arange(len(scores)))[:, None]
    return np.bincount(steps.ravel(), minlength=len(scores) * 8 * STEPS).reshape(len(scores), -1)


def _best(asks: pd.DataFrame, ids: np.ndarray, most: int, score: Callable[[pd.Series], np.ndarray], name: str) -> pd.DataFrame:
    """(query_id, vec_id, score): the ``most`` best ids of each query, scored some queries at a time; the first of those that tie."""
    out = []
    for at in range(0, len(asks), AT_ONCE):
        part = asks.iloc[at : at + AT_ONCE]
        scores = score(part["q"])
        best = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), best.shape[1]), "vec_id": ids[best.ravel()], name: np.take_along_axis(scores, best, 1).ravel().astype(float)}))
    return pd.concat(out)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, similarity): about the ``k`` nearest of each query (query_id, q) among the vectors that fulfil ``where``.

    Probed lists meet their queries by cell, both in parts of bounded size, so neither a crowded cell nor many queries
    of one cell come together in a task; a task returns its short list for each query.
    """
    books = _load(spark, index)
    asked = cut(_probed(queries.select(F.col("query_id").cast("long").alias("query_id"), "q").filter((F.size("q") == index.dim) & (norm(F.col("q")) > 0)), index, books, probes=probes), "index-asked")
    lists = _pruned(lists_of(spark, index), asked, index)
    lists = lists.filter(where) if where is not None else lists
    depth = max(index.shortlist, k)

    many = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("qs"))
    sizes = spark.read.parquet(f"{index.path}/sizes").groupBy("cell").agg(F.ceil(F.sum("rows") / LIST_ROWS).cast("int").alias("ls"))
    parts = F.broadcast(many.join(sizes, "cell"))  # a row for each cell
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = lists.select("cell", "vec_id", "code").join(parts, "cell").select("cell", "vec_id", "code", F.pmod(F.xxhash64("vec_id"), F.col("ls")).cast("int").alias("l"), every("qs").alias("s"))
    left = asked.join(parts, "cell").select("cell", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("s"), every("ls").alias("l"))

    def scored(key: tuple, asks: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        held = books.decoded(np.full(len(rows), key[0]), np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)).T
        for at in range(0, len(asks), AT_ONCE):
            part = asks.iloc[at : at + AT_ONCE]
            q = np.frombuffer(b"".join(part["q"]), dtype=np.float16).reshape(len(part), -1).astype(np.float32)
            yield part, q @ held

    def count(key: tuple, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """How many scores of each query fall into each step."""
        out = [pd.DataFrame({"query_id": [], "step": [], "n": []})]
        if len(asks) and len(rows):
            for part, scores in scored(key, asks, rows):
                n = step_counts(scores)
                row, step = np.nonzero(n)
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "step": step - 4 * STEPS, "n": n[row, step]}))
        return pd.concat(out)

    def meet(key: tuple, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "cell": [], "score": []})]
        if len(asks) and len(rows):
            ids = rows["vec_id"].to_numpy()
            for part, scores in scored(key, asks, rows):
                # a product may differ in its last digit where rows come in another order
                r, c = np.nonzero(scores >= (part["least"].to_numpy()[:, None] / STEPS - 1e-6).astype(np.float32))
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[r], "vec_id": ids[c], "cell": key[0], "score": scores[r, c].astype(float)}))
        return pd.concat(out)

    # First how many scores of a query reach each step, in all its cells; then only rows from the step on that fills its short list leave a task.
    keys = ("cell", "l", "s")
    right = right.groupBy(*keys)
    counted = left.groupBy(*keys).cogroup(right).applyInPandas(count, "query_id long, step long, n long").groupBy("query_id", "step").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("step")))  # at most 8 * STEPS rows a query
    full = counted.withColumn("above", above).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("above") >= depth, F.col("step"))), F.min("step")).alias("least"))
    short = left.join(cut(full, "index-least"), "query_id").groupBy(*keys).cogroup(right).applyInPandas(meet, "query_id long, vec_id long, cell int, score double")
    short = cut(_top(short, "score", depth).select("query_id", "vec_id", "cell"), "index-short")
    exact = lists.select("cell", "vec_id", "v").join(short, ["cell", "vec_id"]).join(queries.select(F.col("query_id").cast("long").alias("query_id"), "q"), "query_id")
    return _ranked(exact, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("similarity"))
    return _top(scored, "similarity", k).select("query_id", "rank", "vec_id", "similarity")


def exact_search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same with the exact ``k`` nearest.

    The index's search gives each query k near vectors. A cell whose centre lies further off than its radius and the k-th of those
    can't hold a nearer one (angles obey the triangle inequality); all other cells are compared in full, in blocks, each task keeping k rows a query.
    """
    books = _load(spark, index)
    near = search(spark, index, queries, k)
    # a query that found fewer than k looks everywhere
    least = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).otherwise(F.lit(-1.0)).alias("least"))
    able = queries.select(F.col("query_id").cast("long").alias("query_id"), "q").filter((F.size("q") == index.dim) & (norm(F.col("q")) > 0))
    sizes = spark.read.parquet(f"{index.path}/sizes").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("rows").alias("rows"))
    radius = np.full(index.cells, -10.0)
    for r in sizes.collect():
        radius[r["cell"]] = r["radius"]
    asked = cut(_probed(able.join(least, "query_id", "left").select("query_id", "q", F.coalesce("least", F.lit(-1.0)).alias("least")), index, books, radius), "index-asked")
    lists = _pruned(lists_of(spark, index), asked, index).select("cell", "vec_id", "v")
    many = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("qs"))
    parts = F.broadcast(many.join(sizes.select("cell", F.ceil(F.col("rows") / (LIST_ROWS // 4)).cast("int").alias("ls")), "cell"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = lists.join(parts, "cell").select("cell", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("ls")).cast("int").alias("l"), every("qs").alias("s"))
    left = asked.join(parts, "cell").select("cell", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("s"), every("ls").alias("l"))

    def meet(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        wide = lambda c: (m := np.stack(c.to_numpy()).astype(float)) / np.linalg.norm(m, axis=1, keepdims=True)
        rows = rows.sort_values("vec_id")
        held = wide(rows["v"]).T
        return _best(asks, rows["vec_id"].to_numpy(), k, lambda q: np.round(wide(q) @ held, 6), "similarity")

    keys = ("cell", "l", "s")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, similarity double")
    return _top(found, "similarity", k).select("query_id", "rank", "vec_id", "similarity")
