"""Exact deduplication as a stateful stream.

The stream reads the document files in micro-batches and keeps one state row per digest of the
normalised text, in RocksDB and without expiry: the smallest doc_id so far, the locator of that
row (file and row number in it) and the number of rows. Rows of one digest are reduced in each
map task before the shuffle, so a text that fills a third of the table costs one row per task.
Every batch writes the state rows it changed, under its batch number, so a repeated batch
overwrites its own output.

A digest that came twice is a hit. The full normalised bytes of all hits are then compared; where
one digest covers different texts, its rows are grouped by the bytes themselves. Only rows whose digest came
twice look their group up, and only those texts move.

Of the rows with one text exactly one stays: that with the smallest doc_id, then the first by file and row number
in it. Rows without doc_id come after all others, so one of them stays only if no other row has the text.

Defined cases: a null text counts as empty; a text that only rows without doc_id have keeps one of them, and
keep_id is null; of repeated rows with the smallest doc_id one stays; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RE, attach, materialize, scratch_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store claims some MB of disk before it has rows
}


#: Hits are marked by slots of their digests: a set whose size is bounded whatever the number of hits.
SLOTS = 1 << 20
#: Settings that the stream takes over from the caller's session.
CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RE, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _own_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose settings are the stream's alone."""
    own = spark.newSession()
    for k in CARRIED:
        own.conf.set(k, spark.conf.get(k))
    for k, v in STATE_CONF.items():
        own.conf.set(k, v)
    return own


def located() -> Column:
    """What orders the rows of one text: those with a doc_id first, by it, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def run_stream(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000, checkpoint: str | None = None) -> DataFrame:
    """Drain the stream over the parquet files at ``path``; (digest, keep struct, group_size) per digest.

    With the same ``checkpoint`` a later call goes on from its state and reads only new files.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    home = checkpoint or scratch_path(spark, "dedup-stream")
    source = _own_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern it may be a file or a folder
    keyed = source.select(digest(normalised("text")).alias("digest"), located().alias("at"))
    state = keyed.groupBy("digest").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/changes/batch={number}")

    query = state.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        changes = spark.read.schema(state.schema).parquet(f"{home}/changes/*")
    except AnalysisException as missing:  # no batch had rows
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        changes = spark.createDataFrame([], state.schema)
    # a digest's size only grows, so its last state is the largest
    return changes.groupBy("digest").agg(F.max_by("keep", "group_size").alias("keep"), F.max("group_size").alias("group_size"))


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, keep_file, keep_row for each row of the parquet files at ``path``."""
    docs = spark.read.parquet(path).select("doc_id", "text", located().alias("at"))
    groups = run_stream(spark, path, digest, files_per_batch).filter("group_size > 1")
    hits = materialize(groups, "dedup-hits")
    rows = docs.select("at", digest(normalised("text")).alias("digest"))
    # A digest that a third of the rows have is a row on the right: broadcast below a counted size, else copied once per salt.
    out = attach(rows, hits, "digest", F.col("at.row")).select("at", F.coalesce("keep", "at").alias("keep"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "digest")

    # Hits: compare the full bytes. Texts whose digest has no hit's slot stay where they are; equal texts collapse in each map task
    # before the shuffle, so what moves is one text for each hit and task.
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = F.broadcast(hits.select(slot).distinct())  # SLOTS numbers at most
    texts = docs.select("at", normalised("text").alias("norm")).withColumn("digest", digest(F.col("norm")))
    by_bytes = texts.withColumn("slot", slot).join(slots, "slot", "left_semi").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    clashes = materialize(by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "dedup-clashes")
    if not clashes.isEmpty():
        clashing = texts.join(clashes, "digest", "left_semi")
        exact = clashing.groupBy("digest", "norm").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        split = clashing.join(exact, ["digest", "norm"]).select("at", "keep", "group_size", "digest")
        out = out.join(clashes, "digest", "left_anti").select(split.columns).unionByName(split)
    return out.select(
        "at.doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep")).alias("kept"), "digest", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row")
    )
