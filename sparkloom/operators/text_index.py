"""A full-text index kept as segments of postings.

A segment holds the postings (term, doc_id, field, tf, doc_len) of the documents of one commit, partitioned by a bucket of the terms' first
letters and sorted by term, and a log of its documents. A commit of new, changed or deleted documents writes one small segment and marks the documents'
earlier places as dead; nothing is rewritten. A search reads the buckets of its terms in the live segments and leaves out what is dead,
so it sees what an index built anew would give. Counts and lengths of the live documents are kept in the manifest, of which each commit writes a new
generation; readers take the newest, so a commit is seen whole or not at all. ``merge`` turns segments into one and drops their dead postings.

Defined cases: a null field has no words; a document without words is counted; a null doc_id can't be told apart from others and is not indexed; of several
changes of one document in a commit the one with the largest ``seq`` counts; repeated rows count once; a search without terms finds nothing.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem_udf
from ..shared import new_path
from .fulltext import B, K1, term_match, tokens
from .graph import cut

BUCKETS, LETTERS = 64, 3
#: Words that one task counts or writes, more or less: a larger commit is more tasks.
TASK_WORDS = 1_000_000
POSTINGS = "term string, doc_id long, field string, tf long, doc_len long, seg string, bucket int"
LOG = "doc_id long, doc_len long, seg string"


@dataclass(frozen=True)
class Manifest:
    """One generation of the index: its live segments with their numbers of postings, and sums over the live documents."""

    path: str
    fields: tuple[str, ...]
    stemmed: bool = False
    generation: int = 0
    segments: tuple[tuple[str, int], ...] = ()
    docs: int = 0
    words: int = 0
    batches: tuple[str, ...] = ()

    def live(self) -> list[str]:
        return [s for s, _ in self.segments]


def create(spark: SparkSession, fields: tuple[str, ...], path: str | None = None, stemmed: bool = False) -> Manifest:
    index = Manifest(path or new_path(spark, "text-index"), tuple(fields), stemmed)
    _publish(spark, index)
    return index


def _publish(spark: SparkSession, m: Manifest) -> None:
    row = json.dumps({k: v for k, v in m.__dict__.items() if k != "path"})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{m.path}/manifest/generation={m.generation}")


def newest(spark: SparkSession, path: str) -> Manifest:
    row = spark.read.text(f"{path}/manifest").orderBy(F.desc("generation")).select("value").first()["value"]
    found = json.loads(row)
    return Manifest(path, tuple(found["fields"]), found["stemmed"], found["generation"], tuple(map(tuple, found["segments"])), found["docs"], found["words"], tuple(found["batches"]))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows below ``path``; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _live(spark: SparkSession, m: Manifest, part: str, schema: str) -> DataFrame:
    rows = _read(spark, f"{m.path}/{part}", schema)
    return rows.filter(F.col("seg").isin(m.live())) if m.segments else rows.limit(0)


def postings(spark: SparkSession, m: Manifest) -> DataFrame:
    """All postings of the live segments, dead ones too."""
    return _live(spark, m, "postings", POSTINGS)


def dead(spark: SparkSession, m: Manifest) -> DataFrame:
    """(doc_id, seg) of the places that later commits replaced. A commit that was not published leaves none, since it is named after its generation."""
    rows = _read(spark, f"{m.path}/dead", f"{LOG}, generation int")
    return rows.filter(F.col("generation") <= m.generation).filter(F.col("seg").isin(m.live())) if m.segments else rows.limit(0)


def bucket(term: Column) -> Column:
    return (F.crc32(F.substring(term, 1, LETTERS).cast("binary")) % BUCKETS).cast("int")


def buckets_of(wanted: list[tuple[str, bool]]) -> list[int]:
    """Where the terms are: one bucket each, all of them for a prefix of fewer letters than a bucket goes by."""
    if any(prefix and len(t) < LETTERS for t, prefix in wanted):
        return list(range(BUCKETS))
    return sorted({zlib.crc32(t[:LETTERS].encode()) % BUCKETS for t, _ in wanted})


def _tasks(spark: SparkSession, words: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / TASK_WORDS))


def _write(rows: DataFrame, m: Manifest, seg: str, words: int) -> int:
    """Postings of one segment, of so many ``words``, by bucket; a crowded bucket is several files, each sorted by term."""
    parts = _tasks(rows.sparkSession, words)
    spread = max(1, parts // 8)
    dealt = rows.withColumn("bucket", bucket(F.col("term"))).withColumn("_file", F.pmod(F.xxhash64("doc_id"), F.lit(spread)))
    dealt.repartition(parts, "bucket", "_file").sortWithinPartitions("bucket", "term").drop("_file", "seg").write.mode("overwrite").partitionBy("bucket").parquet(f"{m.path}/postings/seg={seg}")
    return rows.sparkSession.read.schema("term string, bucket int").parquet(f"{m.path}/postings/seg={seg}").count()


def commit(changes: DataFrame, m: Manifest, batch: str | None = None) -> Manifest:
    """Index ``changes``: doc_id, the fields, and, where given, deleted (boolean) and seq. A ``batch`` that was committed before is skipped.

    The earlier places of the changed documents are found by a join of their ids with the log of live documents; texts are read once.
    """
    spark = changes.sparkSession
    if batch is not None and batch in m.batches:
        return m
    seg, generation = f"g{m.generation + 1:06d}", m.generation + 1
    gone = F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    length = sum((F.size(tokens(text(f))) for f in m.fields), F.lit(0)).cast("long")
    # a hash of the texts breaks ties of seq, so that the log and the postings take the same row, in every run
    order = F.struct(seq.alias("seq"), gone.alias("gone"), F.xxhash64(*m.fields).alias("h"))
    rows = changes.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("o"), length.alias("doc_len"), *[text(f).alias(f"f{k}") for k, f in enumerate(m.fields)])
    log = cut(rows.groupBy("doc_id").agg(F.max(F.struct("o", "doc_len")).alias("r")).select("doc_id", "r.doc_len", "r.o.gone"), "text-log")

    # texts are dealt by doc_id once, into tasks of so many words; what is counted from there on stays in its task
    new_docs, new_words = log.filter("not gone").agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    last = rows.repartition(_tasks(spark, new_words), "doc_id").groupBy("doc_id").agg(F.max_by(F.struct("doc_len", *[f"f{k}" for k in range(len(m.fields))]), "o").alias("r"), F.max("o").alias("o")).filter("not o.gone")
    by = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f"r.f{k}")).alias("w")) for k, f in enumerate(m.fields)])
    flat = last.select("doc_id", "r.doc_len", F.explode(by).alias("x")).select("doc_id", "doc_len", "x.field", F.explode("x.w").alias("term"))
    counted = flat.groupBy("doc_id", "doc_len", "field", "term").agg(F.count(F.lit(1)).alias("tf"))
    if m.stemmed:  # each distinct term is stemmed once
        stems = counted.select("term").distinct().select("term", stem_udf("term").alias("stem"))
        counted = counted.join(stems, "term").groupBy("doc_id", "doc_len", "field", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    n = _write(counted, m, seg, new_words)
    log.filter("not gone").select("doc_id", "doc_len").write.mode("overwrite").parquet(f"{m.path}/log/seg={seg}")

    before = _live(spark, m, "log", LOG).join(dead(spark, m).select("doc_id", "seg"), ["doc_id", "seg"], "left_anti")
    replaced = cut(before.join(log.select("doc_id"), "doc_id", "left_semi"), "text-dead")
    replaced.select("doc_id", "doc_len", "seg").write.mode("overwrite").parquet(f"{m.path}/dead/generation={generation}")
    old_docs, old_words = replaced.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    after = replace(
        m, generation=generation, segments=(*m.segments, (seg, n)), docs=m.docs + new_docs - old_docs, words=m.words + new_words - old_words,
        batches=(*m.batches, batch)[-100:] if batch is not None else m.batches,
    )
    _publish(spark, after)
    return after


def merge(spark: SparkSession, m: Manifest, most: int = 8) -> Manifest:
    """With more than ``most`` segments, the smallest become one, without their dead postings, so that half of ``most`` are left."""
    if len(m.segments) <= most:
        return m
    small = [s for s, _ in sorted(m.segments, key=lambda s: (s[1], s[0]))[: len(m.segments) - max(1, most // 2) + 1]]
    seg, generation = f"g{m.generation + 1:06d}", m.generation + 1
    left_out = dead(spark, m).select("doc_id", "seg")
    chosen = lambda rows: rows.filter(F.col("seg").isin(small)).join(left_out, ["doc_id", "seg"], "left_anti")
    n = _write(chosen(postings(spark, m)).select("term", "doc_id", "field", "tf", "doc_len"), m, seg, sum(k for s, k in m.segments if s in small))
    chosen(_live(spark, m, "log", LOG)).select("doc_id", "doc_len").write.mode("overwrite").parquet(f"{m.path}/log/seg={seg}")
    after = replace(m, generation=generation, segments=(*[s for s in m.segments if s[0] not in small], (seg, n)))
    _publish(spark, after)
    return after


def follow(changes: DataFrame, path: str, name: str, checkpoint: str, most: int = 8) -> Manifest:
    """Drain a stream of changes into the index: each micro-batch is a commit, and segments are merged as they add up. A repeated batch is skipped."""
    spark = changes.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        merge(batch.sparkSession, commit(batch, newest(batch.sparkSession, path), f"{name}:{number}"), most)

    query = changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return newest(spark, path)


def matches(spark: SparkSession, m: Manifest, wanted: list[tuple[str, bool]], fields: tuple[str, ...] | None = None) -> DataFrame:
    """Live postings of ``wanted`` (term, whether it is a prefix), with at: which of them. Only their buckets are read."""
    found = postings(spark, m).filter(F.col("bucket").isin(buckets_of(wanted))).filter(term_match(F.col("term"), wanted))
    if fields:
        found = found.filter(F.col("field").isin(list(fields)))
    found = found.join(dead(spark, m).select("doc_id", "seg"), ["doc_id", "seg"], "left_anti")
    hits = F.array_compact(F.array(*[F.when(term_match(F.col("term"), [w]), k) for k, w in enumerate(wanted)]))
    return found.select("doc_id", "field", "term", "tf", "doc_len", F.explode(hits).alias("at"))


def search(spark: SparkSession, m: Manifest, wanted: list[tuple[str, bool]], weights: dict[str, float] | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, score): BM25 of an OR of ``wanted``. A term's count is summed over the fields by ``weights`` (1 where unset); lengths are those of all fields."""
    if not wanted or not m.docs:
        return spark.createDataFrame([], "doc_id long, score double")
    if m.stemmed:
        plain = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(wanted)], "k int, t string").select("k", stem_udf("t").alias("s")).collect()
        wanted = [(r["s"], wanted[r["k"]][1]) for r in sorted(plain, key=lambda r: r["k"])]
    weight = F.lit(1.0)
    for f, w in (weights or {}).items():
        weight = F.when(F.col("field") == f, float(w)).otherwise(weight)
    tf = cut(matches(spark, m, wanted, fields).groupBy("doc_id", "doc_len", "at").agg(F.sum(F.col("tf") * weight).alias("tf")), "text-matches")
    df = tf.groupBy("at").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(m.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(m.words / m.docs or 1.0)))
    return tf.join(F.broadcast(df), "at").groupBy("doc_id").agg(F.sum(idf * part).alias("score"))
