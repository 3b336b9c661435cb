"""Feature vectors of policy decisions, built from recorded samples, and the split of such examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bordered

# Kinds of query by their words, tried in this order.
QUERY_KINDS = (
    ("debugging", r"\b(error|bug|fix|issue)\b"), ("question", r"\b(how|what|why|when)\b"),
    ("creation", r"\b(create|add|implement|build)\b"), ("lookup", r"\b(find|search|get|list)\b"),
)
TOKENS_PER_TURN, CALLS_PER_TURN = 500, 2


def query_features(text: Column) -> dict[str, Column]:
    """Length, complexity (0 to 1) and kind of a query; a null query is empty and general."""
    said = F.coalesce(text, F.lit(""))
    words = F.when(said == "", 0).otherwise(F.size(F.split(said, r"\s+")))
    operators = F.when(said.rlike(r'[&|"()]'), 0.3).otherwise(0.0)
    return {
        "query_length": F.length(said),
        "has_keywords": said != "",
        "query_complexity": F.round(F.least(F.lit(1.0), words / 20.0 + operators), 6),
        "query_kind": F.coalesce(*[F.when(F.lower(said).rlike(bordered(p)), kind) for kind, p in QUERY_KINDS], F.lit("general")),
    }


def retrieval_examples(samples: DataFrame) -> DataFrame:
    """State, action and reward of retrievals (id, query, entry_type, rank, contribution); those without a contribution are none."""
    rank, score = F.coalesce("rank", F.lit(1)), F.col("contribution")
    return samples.filter(score.isNotNull()).select(
        "id", *[c.alias(name) for name, c in query_features(F.col("query")).items()],
        rank.alias("turn_number"), F.least(F.lit(5), rank).alias("recent_calls"), (score < 0).alias("has_errors"), (rank * 10).alias("total_entries"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 2 + 0.5)), 6).alias("success"), F.col("entry_type").alias("action_type"), F.round(score, 6).alias("reward"),
    )


def extraction_examples(samples: DataFrame) -> DataFrame:
    """State, action and reward of extractions (id, turn, confidence, retrievals, entry_type, decision, outcome)."""
    turn, uses, sure, kind = F.coalesce("turn", F.lit(0)), F.coalesce("retrievals", F.lit(0)), F.col("confidence"), F.col("entry_type")
    return samples.filter("outcome is not null").select(
        "id", turn.alias("turn_number"), (turn * TOKENS_PER_TURN).alias("token_count"), (turn * CALLS_PER_TURN).alias("tool_calls"), (F.col("outcome") < 0).alias("has_error"),
        F.ceil(turn / 2).cast("long").alias("user_turns"), F.floor(turn / 2).cast("long").alias("assistant_turns"), (uses * 10).alias("total_entries"),
        (F.coalesce(sure, F.lit(1.0)) < 0.5).alias("similar_exists"), F.greatest(F.lit(1), uses).alias("captures"), (kind == "knowledge").alias("has_decision"),
        (kind == "guideline").alias("has_rule"), (kind == "tool").alias("has_command"), F.round(F.coalesce(sure, F.lit(0.5)), 6).alias("novelty"),
        F.when(kind == "tool", 0.7).otherwise(0.5).alias("complexity"), "decision", F.round("outcome", 6).alias("reward"),
    )


def is_eval(key: Column) -> Column:
    """A split by hash of the id, the same in every run: 52 of 256 for evaluation."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int") < 52
