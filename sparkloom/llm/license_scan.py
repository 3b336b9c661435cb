"""License scans: sparse TF-IDF cosine against templates, then inheritance from the nearest directory.

A text's units are its lines, its blocks (two or more lines between lines without terms, so a wrapped header or a paragraph),
its leading comment (what comes before the first line of code, where the text starts with a comment sign) and the text itself.
Units and templates are sparse TF-IDF vectors; the inverse document frequencies are those of the templates,
and a term that no template has gets the highest. A unit that reaches ``threshold`` gives its file that licence; of several the
one with the most matched weight (the unit's norm times the cube of the cosine), so a full text counts for more than a
sentence in it, and a unit of little else for more than the same with code around it.

A licence file covers its directory: one whose name says so (``NAMED``) and of which any unit reaches the threshold, or one that
reaches it as a whole and is not source code by its suffix (``PROSE``). So a source file that holds little but a header covers nothing.
A file without own licence takes that of its nearest ancestor directory. DataFrame operations only.

Only units that can reach the threshold are split into rows of terms. The dot product with a template is a sum over a
unit's tokens, and the unit's norm is at least that of its known terms together with one ``unseen`` weight for each token that no
template has. Both are taken over the unit's own token array, first by its length, then by the best weight that any template gives
each token, then for each template; what stays below the threshold there stays below it in truth. So nothing is lost, and what is
shuffled are the few units left.

Defined cases: null and empty texts have no licence of their own; a file without a path (null or empty) covers nothing and inherits nothing; ties go to the
smaller licence name; equal rows get equal results; an empty table works; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize
from .license_texts import TEMPLATES

THRESHOLD = 0.6
TERM_RE = r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*"
#: Names of licence files, and suffixes of files that are text and not code.
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"
PROSE = r"(?i)(^|/)[^/.]*$|\.(txt|md|rst|text)$"
#: What a line of a leading comment starts with.
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--|\"{3}|'{3})"
#: Steps that the best gains are rounded up to; coarser steps only let more units through to the exact score.
GAIN_STEP = 0.05
BUCKETS = 1024


def terms(text: str) -> list[str]:
    return re.findall(TERM_RE, text.lower())


class Model:
    """TF-IDF weights of the templates; a few hundred numbers."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        bags = [Counter(terms(text)) for _, text in templates]
        df = Counter(t for bag in bags for t in bag)
        self.threshold = threshold
        self.idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in sorted(df.items())}
        self.unseen = math.log(1 + len(bags)) + 1
        self.weights: list[tuple[int, str, str, float]] = []
        for k, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
            w = {t: n * self.idf[t] for t, n in bag.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.weights += [(k, name, t, x / norm) for t, x in sorted(w.items())]

    def most(self) -> dict[str, float]:
        """What one more token of each term adds to the dot product with any template at most, rounded up to steps."""
        out: dict[str, float] = {}
        for _, _, t, x in self.weights:
            out[t] = max(out.get(t, 0.0), x * self.idf[t])
        return {t: math.ceil(x / GAIN_STEP) * GAIN_STEP for t, x in out.items()}

    def gains(self) -> str:
        """JSON of a hash table, ``BUCKETS`` lists of (term, what one more token of it adds to the dot product with each template)."""
        width = 1 + max((k for k, *_ in self.weights), default=-1)
        rows: dict[str, list[float]] = {}
        for k, _, t, x in self.weights:
            rows.setdefault(t, [0.0] * width)[k] = x * self.idf[t]
        table: list[list[dict]] = [[] for _ in range(BUCKETS)]
        for t, w in sorted(rows.items()):
            table[zlib.crc32(t.encode()) % BUCKETS].append({"t": t, "w": w})
        return json.dumps(table)


def _level(term: Column, values: dict[str, float]) -> Column:
    """A term's value; one set of terms for each of the few values."""
    out = F.lit(0.0)
    for value in sorted(set(values.values())):
        out = F.when(term.isin([t for t, x in sorted(values.items()) if x == value]), F.lit(value)).otherwise(out)
    return out


def _once(value: Column) -> Column:
    """The value by way of a generator: filters on it are not pushed below, so it is computed once a row."""
    return F.explode(F.array(value))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _units() -> Column:
    """Units of a row (terms and known by line, code: the first line of code or null): structs of id, terms, known.

    Ids: lines from 0 up, -1 the text, -2 the leading comment, blocks from -3 down.
    """

    def unit(number: Column, first: Column, n: Column) -> Column:
        part = lambda c: F.flatten(F.slice(c, first + 1, n))
        return F.struct(number.cast("int").alias("line"), part("terms").alias("terms"), part("known").alias("known"))

    n = F.size("terms")
    empty = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.size(F.get("terms", k)) == 0)
    edges = F.concat(F.array(F.lit(-1)), empty, F.array(n))
    spans = F.transform(F.slice(edges, 2, F.size(edges)), lambda stop, k: F.struct((F.get(edges, k) + 1).alias("first"), (stop - F.get(edges, k) - 1).alias("n")))
    blocks = F.filter(spans, lambda s: (s["n"] >= 2) & (s["n"] < n))
    lead = F.when(F.col("code") >= 2, F.array(unit(F.lit(-2), F.lit(0), F.col("code")))).otherwise(F.array())
    return F.concat(
        F.array(unit(F.lit(-1), F.lit(0), n)), lead,
        F.transform(blocks, lambda s, k: unit(-3 - k, s["first"], s["n"])),
        F.transform("terms", lambda t, k: F.struct(k.cast("int").alias("line"), t.alias("terms"), F.get("known", k).alias("known"))),
    )


def able_units(texts: DataFrame, model: Model) -> DataFrame:
    """path, row_key, line (-1 for the whole text), terms of the units of ``texts`` (path, row_key, text) that may reach the threshold."""
    lines = F.split("text", "\n")
    per_line = F.transform(lines, lambda line: F.regexp_extract_all(F.lower(line), F.lit(f"({TERM_RE})"), F.lit(1)))
    split = texts.select("path", "row_key", "text", _once(per_line).alias("terms"))
    known = F.transform("terms", lambda t: F.filter(t, lambda x: x.isin(*model.idf)))
    # the lines before the first that has terms and is no comment; all of them where there is none
    code = F.array_position(F.transform(lines, lambda line: ~line.rlike(COMMENT) & line.rlike("[A-Za-z0-9]")), True)
    code = F.when(F.ltrim("text").rlike(COMMENT), F.when(code > 0, code - 1).otherwise(F.size(lines))).cast("int")
    split = split.select("path", "row_key", "terms", _once(known).alias("known"), code.alias("code")).filter(F.exists("known", lambda t: F.size(t) > 0))
    most, square = model.most(), (model.threshold - 1e-6) ** 2  # scores are rounded
    strange = lambda terms, known: model.unseen**2 * (F.size(terms) - F.size(known))
    enough = lambda reach, extra: reach * reach * (1 - square) >= square * extra
    long_enough = lambda u: (F.size(u["known"]) > 0) & enough(F.size(u["known"]) * max(most.values(), default=0.0), strange(u["terms"], u["known"]))
    units = split.select("path", "row_key", F.explode(F.filter(_units(), long_enough)).alias("u")).select("path", "row_key", "u.line", "u.terms", "u.known")
    reach = _sum(F.transform("known", lambda t: _level(t, most)))
    near = units.select("*", _once(reach).alias("reach")).filter(enough(F.col("reach"), strange("terms", "known")))
    counts = F.transform(F.array_distinct("known"), lambda t: F.struct(t.alias("term"), F.size(F.filter("known", lambda x: x == t)).alias("n")))
    norm2 = _sum(F.transform("counts", lambda c: F.pow(c["n"] * _level(c["term"], model.idf), F.lit(2.0))))
    near = near.select("*", _once(counts).alias("counts")).select("*", _once(norm2).alias("norm2"))
    near = near.filter(F.col("reach") * F.col("reach") >= square * (F.col("norm2") + strange("terms", "known")))
    best = near.select("*", _once(F.array_max(_dots("counts", model))).alias("best"))
    return best.filter(F.col("best") * F.col("best") >= square * (F.col("norm2") + strange("terms", "known"))).select("path", "row_key", "line", "terms")


def _dots(counts: str, model: Model) -> Column:
    """The dot product with each template of (term, n) pairs; each term is looked up once."""
    table = F.from_json(F.lit(model.gains()), "array<array<struct<t: string, w: array<double>>>>")
    width = 1 + max((k for k, *_ in model.weights), default=-1)

    def gain(term: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["t"] == term), F.lit(0))["w"]

    return F.aggregate(counts, F.array_repeat(F.lit(0.0), width), lambda acc, c: F.zip_with(acc, gain(c["term"]), lambda a, w: a + c["n"] * w))


def license_scan(files: DataFrame, model: Model | None = None) -> DataFrame:
    """path, row_key, license, score, is_license_file, origin, from_dir for each row of ``files`` (path, text).

    origin: own, inherited or none.
    """
    model = model or Model()
    spark = files.sparkSession
    path = F.coalesce("path", F.lit(""))
    named = files.select(path.alias("path"), "text", F.xxhash64(path, "text").alias("row_key"))
    units = able_units(named, model).dropDuplicates(["path", "row_key", "line"]).select("path", "row_key", "line", F.explode("terms").alias("term"))
    tf = materialize(units.groupBy("path", "row_key", "line", "term").agg(F.count(F.lit(1)).alias("tf")), "license-terms")

    # a few hundred rows, whatever the input
    weights = F.broadcast(spark.createDataFrame(model.weights, "template int, license string, term string, weight double"))
    idf = F.broadcast(spark.createDataFrame(sorted(model.idf.items()), "term string, idf double"))
    vectors = tf.join(idf, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(model.unseen)))
    unit = ["path", "row_key", "line"]
    norms = vectors.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = vectors.join(weights, "term").groupBy(*unit, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, unit).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= model.threshold)
    # the best: most matched weight, then the highest score, then the smaller name (negated, so that it is one minimum)
    found = F.struct((-F.round(F.col("dot") * F.pow(F.col("dot") / F.col("norm"), F.lit(2.0)), 6)).alias("mass"), (-F.col("score")).alias("s"), "license")
    best = scores.groupBy("path", "row_key").agg(F.min(found).alias("own"), F.min(F.when(F.col("line") == -1, found)).alias("whole"))
    # where a file without a path lies is not known, so it covers nothing
    covering = F.when(F.col("path") == "", F.lit(None)).when(F.col("path").rlike(NAMED), F.coalesce("whole", "own")).when(F.col("path").rlike(PROSE), F.col("whole"))
    best = materialize(best.withColumn("file", covering), "license-best")

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    covers = best.filter("file is not null").groupBy(folder.alias("dir")).agg(F.min("file").alias("file"))
    covers = covers.select("dir", F.col("file.license").alias("license"), (-F.col("file.s")).alias("score"))
    # each distinct directory once: its ancestors, joined on the path, the deepest wins
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = named.select(folder.alias("dir")).distinct()
    above = dirs.select(F.col("dir").alias("of"), F.explode(F.array_distinct(up)).alias("dir"))
    # every directory has the top one above it: that key is spread
    above = attach(above, covers, "dir", F.xxhash64("of")).filter("license is not null")
    nearest = above.groupBy("of").agg(F.max_by(F.struct("dir", "license", "score"), F.length("dir")).alias("near"))
    nearest = nearest.select(F.col("of").alias("dir"), "near")

    rows = named.select("path", "row_key", folder.alias("dir")).join(best, ["path", "row_key"], "left")
    rows = attach(rows, nearest, "dir", F.col("row_key"))
    own, near = F.col("own"), F.when(F.col("path") != "", F.col("near"))
    return rows.select(
        "path", "row_key",
        F.coalesce(own["license"], near["license"]).alias("license"),
        F.coalesce(-own["s"], near["score"]).alias("score"),
        F.col("file").isNotNull().alias("is_license_file"),
        F.when(own.isNotNull(), "own").when(near.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own.isNull(), near["dir"]).alias("from_dir"),
    )
