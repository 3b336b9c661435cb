"""Export to and import from files: JSON lines, training-set formats, CSV, Markdown; merges of imported entries.

Exports are columns of ready lines; ``write_lines`` puts them into a folder of text files, one per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE_NAMES = {"user": "human", "assistant": "gpt", "system": "system"}
STRATEGIES = ("skip", "update", "replace", "error")


def _role() -> Column:
    return F.coalesce("role", F.lit(""))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def conversation_lines(turns: DataFrame, style: str) -> DataFrame:
    """(conv_id, line): one JSON line per conversation (conv_id, turn, role, text).

    openai: all turns as messages; anthropic: system turns apart; sharegpt: from/value pairs. One conversation's turns meet
    in one row, which is what the formats ask for.
    """
    if style == "sharegpt":
        speaker = F.coalesce(*[F.when(_role() == k, v) for k, v in ROLE_NAMES.items()], _role())
        message = F.struct(speaker.alias("from"), _text().alias("value"))
    else:
        message = F.struct(_role().alias("role"), _text().alias("content"))
    in_order = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", message.alias("m"))))), lambda s: s["m"])
    every, system = F.lit(True), _role() == "system"
    by = turns.groupBy("conv_id")
    if style == "openai":
        return by.agg(F.to_json(F.struct(in_order(every).alias("messages"))).alias("line"))
    if style == "sharegpt":
        return by.agg(F.to_json(F.struct(in_order(every).alias("conversations"))).alias("line"))
    if style == "anthropic":
        preamble = F.array_join(F.transform(in_order(system), lambda m: m["content"]), "\n")
        return by.agg(F.to_json(F.struct(preamble.alias("system"), in_order(~system).alias("messages"))).alias("line"))
    raise ValueError(f"unknown style {style}")


def alpaca_lines(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line): each assistant turn that follows a user turn directly, as instruction and output."""
    asked = turns.filter(_role() == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), _text().alias("instruction"))
    answered = turns.filter(_role() == "assistant").select("conv_id", "turn", _text().alias("output"))
    line = F.to_json(F.struct("instruction", F.lit("").alias("input"), "output"))
    return asked.join(answered, ["conv_id", "turn"]).select("conv_id", "turn", line.alias("line"))


def entry_lines(entries: DataFrame) -> DataFrame:
    """(entry_id, line): entries as JSON lines."""
    return entries.select("entry_id", F.to_json(F.struct("entry_id", "entry_type", "title", "category", "priority")).alias("line"))


def markdown(entries: DataFrame) -> DataFrame:
    """(entry_id, line): a heading, the facts and the content of each entry."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    parts = F.concat(F.lit("## "), none("title"), F.lit("\n\n- type: "), none("entry_type"), F.lit("\n- category: "), none("category"), F.lit("\n- priority: "), none("priority"))
    return entries.select("entry_id", parts.alias("line"))


def yaml(entries: DataFrame) -> DataFrame:
    """(entry_id, line): a YAML list item of each entry; JSON strings are valid YAML scalars."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(F.col(c).cast("string"))), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    fields = [F.concat(F.lit(f"{lead}{c}: "), quoted(c)) for lead, c in (("- ", "entry_id"), ("  ", "entry_type"), ("  ", "title"), ("  ", "category"))]
    return entries.select("entry_id", F.concat_ws("\n", *fields).alias("line"))


def openapi_paths(tools: DataFrame) -> DataFrame:
    """(entry_id, line): each tool as an OpenAPI path item."""
    item = F.struct(F.struct(F.concat(F.lit("tool_"), "entry_id").alias("operationId"), F.coalesce("title", F.lit("")).alias("summary")).alias("post"))
    return tools.select("entry_id", F.to_json(F.struct(F.concat(F.lit("/tools/"), "entry_id").alias("path"), item.alias("item"))).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema, so that no pass over the files is spent on guessing it."""
    return spark.read.schema(schema).json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text) of transcript files, one JSON object with a message list per line."""
    found = read_json(spark, path, "conv_id long, messages array<struct<role:string,content:string>>")
    return found.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"))


def merge_import(existing: DataFrame, incoming: DataFrame, key: str, strategy: str) -> DataFrame:
    """``existing`` and ``incoming`` (same columns) by ``key``, with what became of each row in ``outcome``.

    skip keeps what is there; update takes the incoming values that aren't null; replace takes the incoming row; error
    raises on any conflict. Rows of either side alone are kept or inserted.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    others = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*others).alias("_old"), F.lit(True).alias("_had"))
    new = incoming.select(key, F.struct(*others).alias("_new"), F.lit(True).alias("_came"))
    both = old.join(new, key, "full")
    had, came = F.col("_had").isNotNull(), F.col("_came").isNotNull()
    if strategy == "error" and not both.filter(had & came).isEmpty():
        raise ValueError("the import has keys that are there already")

    def value(c: str) -> Column:
        old_c, new_c = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        on_both = {"skip": old_c, "update": F.coalesce(new_c, old_c)}.get(strategy, new_c)
        return F.when(had & came, on_both).when(came, new_c).otherwise(old_c).alias(c)

    outcome = F.when(~came, "kept").when(~had, "inserted").otherwise({"skip": "skipped", "update": "updated"}.get(strategy, "replaced"))
    return both.select(key, *[value(c) for c in others], outcome.alias("outcome"))


def split_lines(examples: DataFrame) -> DataFrame:
    """(id, split, line) of training examples (id, is_eval, state, action, reward)."""
    return examples.select("id", F.when(F.col("is_eval"), "test").otherwise("train").alias("split"), F.to_json(F.struct("state", "action", "reward")).alias("line"))


def write_splits(lines: DataFrame, path: str, name: str) -> None:
    """A dataset folder: the lines of each split under its name, and ``dataset_dict`` with the number of examples of each."""
    lines.select("split", "line").write.mode("overwrite").partitionBy("split").text(f"{path}/data")
    sizes = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    split = F.struct(F.col("split").alias("name"), F.col("n").alias("num_examples"), F.lit(name).alias("dataset_name"))
    every = sizes.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("split", split.alias("about")))).alias("splits"))).alias("line"))
    every.coalesce(1).write.mode("overwrite").text(f"{path}/dataset_dict")
