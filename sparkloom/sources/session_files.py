"""Transcripts that an editor keeps as many small JSON files: session/<project>/*.json, message/<session>/*.json, part/<message>/*.json.

A message's text is that of its text parts in the order of their file names. A message without text but with tool calls shows those instead, one line a call.
Whole folders are read by Spark's own JSON reader, in as many tasks as there is data, from any store Spark can read; ``sync`` reads them as streams, which
remember by their checkpoints what was read, so a second call reads new files only and gives the messages that these touch.

Defined cases: files that are no JSON, and rows without an id, are left out; of two files with one id the later by modification time, then by name, counts;
sessions of the project folder ``global`` are left out; a message without text and tools is left out, and so is one without time; parts of
messages that are not there yet wait.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How much of a tool's input is shown, of its output kept, and what marks a cut.
INPUT_SHOWN, OUTPUT_KEPT, CUT = 100, 5000, "... [truncated]"

SCHEMAS = {
    "session": "id string, slug string, projectID string, directory string, title string, time struct<created: bigint, updated: bigint>",
    "message": "id string, sessionID string, role string, time struct<created: bigint>, agent string, model struct<providerID: string, modelID: string>",
    "part": "id string, sessionID string, messageID string, type string, text string, tool string, state struct<status: string, input: string, output: string>",
}
_ORIGIN = ", file string, modified timestamp"


@dataclass(frozen=True)
class Files:
    """The three kinds of rows, each with the file it came from and when that was modified."""

    session: DataFrame
    message: DataFrame
    part: DataFrame


def _with_origin(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"file": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time")}).filter("id is not null")


def read_files(spark: SparkSession, base: str, lines: bool = False) -> Files:
    """All files below ``base``. ``lines``: a file holds an object on each line instead of one over many."""
    read = lambda kind: _with_origin(spark.read.schema(SCHEMAS[kind]).option("multiLine", not lines).json(f"{base}/{kind}/*/*.json"))
    return Files(read("session"), read("message"), read("part"))


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: that of the file modified last."""
    rest = [c for c in rows.columns if c not in keys]
    by = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("modified", "file")).alias("_r"))
    return by.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def _instant(millis: str) -> Column:
    return F.timestamp_millis(F.col(millis))


def sessions(files: Files, project: str | None = None) -> DataFrame:
    """(session_id, project_path, title, created, updated), of one project's directory if it is given."""
    rows = files.session.filter(~F.col("file").rlike(r"/session/global/[^/]*$"))
    rows = _latest(rows.filter(F.col("directory") == project) if project is not None else rows, "id")
    return rows.select(F.col("id").alias("session_id"), F.col("directory").alias("project_path"), F.coalesce("title", "slug").alias("title"), _instant("time.created").alias("created"), _instant("time.updated").alias("updated"))


def _compact(given: Column) -> Column:
    """JSON without the white space between its values."""
    return F.regexp_replace(given, r'("(?:[^"\\]|\\.)*")|\s+', "$1")


def _shown(p: Column) -> Column:
    """A tool call as one line: its name, its status unless it is completed, the head of its input."""
    state, given = p["state"], _compact(p["state"]["input"])
    head = F.when(F.length(given) > INPUT_SHOWN, F.concat(F.substring(given, 1, INPUT_SHOWN), F.lit("..."))).otherwise(given)
    status = F.when(F.coalesce(state["status"], F.lit("")) == "", "unknown").otherwise(state["status"])
    line = F.concat(F.lit("["), p["tool"], F.when(status != "completed", F.concat(F.lit(" ("), status, F.lit(")"))).otherwise(""), F.when(given.isNotNull(), F.concat(F.lit(": "), head)).otherwise(""), F.lit("]"))
    return F.when(state.isNull(), F.concat(F.lit("[Tool calls: "), p["tool"], F.lit("]"))).otherwise(line)


def messages(files: Files, after_ms: int | None = None, before_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """(session_id, message_id, role, at, content, tools, calls, agent, model), of each session the first ``limit`` by time if that is given.

    ``calls``: name, status, input and output of each tool call that stands for the text. A message's parts meet in one row; a session's messages do not.
    """
    from pyspark.sql import Window

    rows = _latest(files.message, "id").filter("time.created is not null")
    rows = rows.filter(F.col("time.created") >= after_ms) if after_ms is not None else rows
    rows = rows.filter(F.col("time.created") <= before_ms) if before_ms is not None else rows
    useful = files.part.filter("(type = 'text' and text <> '') or (type = 'tool' and tool <> '')")
    part = _latest(useful.filter("messageID is not null"), "messageID", "id")
    name = F.element_at(F.split("file", "/"), -1)
    of = part.groupBy("messageID").agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), "id", "type", "text", "tool", "state"))).alias("parts"))
    both = rows.join(of, rows["id"] == of["messageID"])
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    used = F.filter("parts", lambda p: p["type"] == "tool")
    both = both.withColumn("_text", text).withColumn("_used", used)
    kept = lambda o: F.when(F.length(o) > OUTPUT_KEPT, F.concat(F.substring(o, 1, OUTPUT_KEPT), F.lit(CUT))).otherwise(o)
    call = lambda p: F.struct(p["tool"].alias("name"), F.coalesce(p["state"]["status"], F.lit("unknown")).alias("status"), _compact(p["state"]["input"]).alias("input"), kept(p["state"]["output"]).alias("output"))
    calls = F.when(F.col("_text") == "", F.transform(F.filter("_used", lambda p: p["state"].isNotNull()), call)).otherwise(F.array())
    found = both.select(
        F.col("sessionID").alias("session_id"), rows["id"].alias("message_id"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), _instant("time.created").alias("at"),
        F.when(F.col("_text") != "", F.col("_text")).otherwise(F.array_join(F.transform("_used", _shown), "\n")).alias("content"),
        F.transform("_used", lambda p: p["tool"]).alias("tools"), calls.alias("calls"), "agent", F.col("model.modelID").alias("model"),
    )
    if limit is None:
        return found
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "message_id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def sync(spark: SparkSession, base: str, store: str, lines: bool = False, files_per_batch: int = 10_000) -> DataFrame:
    """Read the files that are new below ``base`` into ``store``, and return the messages that they bring or change.

    The rows of each micro-batch are written under its number, so a repeated batch adds nothing; ``stored`` reads them all.
    """
    fresh = {}
    for kind, schema in SCHEMAS.items():
        before = _stored_files(spark, store, kind).select("batch").distinct()
        known = {r["batch"] for r in before.collect()}  # numbers of batches

        def write(batch: DataFrame, number: int, kind: str = kind) -> None:
            batch.write.mode("overwrite").parquet(f"{store}/{kind}/batch={number}")

        stream = spark.readStream.schema(schema).option("multiLine", not lines).option("maxFilesPerTrigger", files_per_batch).json(f"{base}/{kind}/*/*.json")
        _with_origin(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/checkpoints/{kind}").trigger(availableNow=True).start().awaitTermination()
        rows = _stored_files(spark, store, kind)
        fresh[kind] = rows.filter(~F.col("batch").isin(sorted(known))) if known else rows
    ids = fresh["message"].select("id").unionByName(fresh["part"].select(F.col("messageID").alias("id"))).distinct()
    every = stored(spark, store)
    touched = Files(every.session, every.message.join(ids, "id", "left_semi"), every.part.join(ids.withColumnRenamed("id", "messageID"), "messageID", "left_semi"))
    return messages(touched)


def _stored_files(spark: SparkSession, store: str, kind: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    schema = f"{SCHEMAS[kind]}{_ORIGIN}, batch int"
    try:
        return spark.read.schema(schema).parquet(f"{store}/{kind}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored(spark: SparkSession, store: str) -> Files:
    return Files(*[_stored_files(spark, store, kind).drop("batch") for kind in ("session", "message", "part")])
