"""Preference formatting: the common turns of a chosen and a rejected conversation become one prompt.

The longest common prefix of turns (same place, role and text) is rendered once as the prompt;
what follows on each side is a completion, in segments that say whether loss is taken on them
(``assistant`` turns) or they are masked. DataFrame operations only.

Turns are compared in one grouping on (pair, turn, role, text): nothing of a pair is gathered or ranked
to find the prefix. ``preference_turns`` stays one row per turn, so a conversation of any length is
spread over tasks; ``preference_rows`` gathers one pair's text in the end, which is what is asked for.

Defined cases: a null role or text counts as empty; a null turn number comes first; rows with the same
turn number are one turn, ordered by role and text, and equal rows stay as often as they come: a turn is common if both sides have each row equally often; rows without pair or of another
side are ignored; a pair with one side only has an empty prompt and an empty completion on the other side; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("chosen", "rejected")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def preference_turns(turns: DataFrame) -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen, rejected), turn, role, text, loss.

    ``turns``: pair_id, side, turn, role, text. A common turn appears once, in the prompt.
    """
    rows = turns.select(
        "pair_id", "side", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).filter(F.col("pair_id").isNotNull() & F.col("side").isin(*SIDES))
    turn = ["pair_id", "turn", "role", "text"]
    times = lambda side: F.count_if(F.col("side") == side).cast("int").alias(side)
    once = rows.groupBy(*turn).agg(*[times(side) for side in SIDES])
    differs = once.filter("chosen <> rejected").groupBy("pair_id").agg(F.min("turn").alias("stop"))
    placed = once.join(differs, "pair_id", "left").withColumn("common", F.col("stop").isNull() | (F.col("turn") < F.col("stop")))
    sides = F.concat(*[F.array_repeat(F.lit(side), F.col(side)) for side in SIDES])
    part = F.when(F.col("common"), F.array_repeat(F.lit("prompt"), F.col("chosen"))).otherwise(sides)
    return placed.select(
        "pair_id", F.explode(part).alias("part"), "turn", "role",
        rendered(F.col("role"), F.col("text")).alias("text"),
        (~F.col("common") & (F.col("role") == "assistant")).alias("loss"),
    )


def preference_rows(turns: DataFrame) -> DataFrame:
    """One row per pair: prompt, prompt_turns, and per side the completion, its turns and its mask.

    The mask is a list ``start:stop`` of character spans of the completion that carry loss, comma-joined.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "loss")))
    folded = preference_turns(turns).groupBy("pair_id", "part").agg(ordered.alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def span(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x["text"])
        own = F.when(x["loss"], F.array(F.concat_ws(":", acc["at"], stop))).otherwise(F.array().cast("array<string>"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    folded = folded.select(
        "pair_id", "part",
        F.array_join(F.col("all.text"), "").alias("text"),
        F.size("all").cast("long").alias("n"),
        F.array_join(F.aggregate("all", start, span)["spans"], ",").alias("mask"),
    )
    pick = lambda part, column: F.max(F.when(F.col("part") == part, F.col(column)))
    return folded.groupBy("pair_id").agg(
        F.coalesce(pick("prompt", "text"), F.lit("")).alias("prompt"),
        F.coalesce(pick("prompt", "n"), F.lit(0)).cast("long").alias("prompt_turns"),
        *[
            F.coalesce(pick(side, column), F.lit(none)).cast(kind).alias(name)
            for side in SIDES
            for column, none, kind, name in (("text", "", "string", side), ("n", 0, "long", f"{side}_turns"), ("mask", "", "string", f"{side}_mask"))
        ],
    )


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a plain conversation table (conv_id, turn, role, text).

    Each conversation is chosen; it is rejected with the text of its last assistant turn replaced by that of
    the conversation with the next id. Where that has none, the rejected side lacks the turn.
    """
    own = conversations.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text").filter("conv_id is not null")
    last = own.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    donors = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"), F.lit(True).alias("given"))
    rows = own.join(last.select("conv_id", F.col("last.turn").alias("at")).join(donors, "conv_id", "left"), "conv_id", "left")
    swap = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("at")), F.lit(False))
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = rows.filter(~swap | F.col("given")).select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", F.when(swap, F.col("other")).otherwise(F.col("text")).alias("text")
    )
    return chosen.unionByName(rejected)
