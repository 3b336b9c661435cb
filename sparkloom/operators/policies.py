"""Decision tables and confidence formulas as column expressions over a state row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much each entry type counts under each intent, and the share of semantic score in a hybrid.
INTENT_TYPE_WEIGHTS = {
    "lookup": {"knowledge": 1.15, "guideline": 0.95, "tool": 0.95, "experience": 0.9},
    "how_to": {"guideline": 1.15, "experience": 1.1, "tool": 1.0, "knowledge": 0.95},
    "debug": {"experience": 1.15, "knowledge": 1.05, "guideline": 0.95, "tool": 0.95},
    "explore": {"knowledge": 1.0, "guideline": 1.0, "experience": 1.0, "tool": 1.0},
    "compare": {"knowledge": 1.1, "experience": 1.05, "guideline": 0.95, "tool": 0.95},
    "configure": {"guideline": 1.15, "tool": 1.1, "knowledge": 0.95, "experience": 0.95},
}
INTENT_ALPHA = {"lookup": 0.5, "how_to": 0.7, "debug": 0.6, "explore": 0.8, "compare": 0.75, "configure": 0.6}


def first_of(*rules: tuple[Column, str], default: str) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(test, name) for test, name in rules], F.lit(default))


def intent_weight(intent: str, entry_type: Column) -> Column:
    return F.coalesce(*[F.when(entry_type == t, w) for t, w in INTENT_TYPE_WEIGHTS[intent].items()], F.lit(1.0))


def retrieval_policy(complexity: Column, keywords: Column, errors: Column, length: Column, success: Column, recent: Column, depth: Column, tool_calls: Column, total: Column) -> Column:
    """Why to retrieve or not; ``simple_query`` and ``low_utility_memory`` are the two that don't."""
    return first_of(
        (keywords & (complexity > 0.6), "complex_query_with_keywords"),
        (errors, "error_recovery"),
        ((length < 20) & (complexity < 0.3) & ~keywords, "simple_query"),
        ((success > 0.7) & (recent > 0), "recent_success"),
        (depth > 10, "deep_conversation"),
        (tool_calls > 3, "tool_heavy"),
        ((total == 0) | ((success < 0.3) & (recent > 5)), "low_utility_memory"),
        default="default",
    )


def extraction_policy(similar: Column, error: Column, rule: Column, command: Column, decision: Column, fact: Column, novelty: Column, complexity: Column, turn: Column, captures: Column) -> Column:
    """Whether a message is stored, deferred or skipped, as ``decision:reason``."""
    return first_of(
        (similar, "skip:duplicate_content"),
        (error, "store:error_occurred"),
        (rule | command | (decision & (novelty > 0.7)), "store:strong_content_signal"),
        ((turn < 3) & ~fact, "defer:early_conversation"),
        ((novelty > 0.6) & (complexity > 0.5), "store:high_novelty"),
        ((captures > 5) & (novelty < 0.5), "skip:capture_rate_limit"),
        default="skip:low_value_content",
    )


def consolidation_policy(low_sim: Column, mean_sim: Column, size: Column, retrievals: Column, idle_days: Column, success: Column, types: Column) -> Column:
    """What becomes of a group of similar entries, as ``action:reason``."""
    return first_of(
        ((low_sim > 0.95) & (size > 1), "dedupe:exact_duplicates"),
        ((retrievals == 0) & (idle_days > 90), "archive:unused_old_entries"),
        ((success < 0.3) & (idle_days > 60) & (retrievals > 5), "archive:low_success_old_entries"),
        ((mean_sim > 0.8) & (retrievals < 10) & (size >= 2), "merge:similar_low_usage"),
        ((size >= 5) & (retrievals > 50) & (success > 0.6), "abstract:pattern_abstraction"),
        ((mean_sim > 0.7) & (types == 1) & (size >= 3), "merge:similar_same_type"),
        default="keep:default",
    )


def entity_boost(hits: Column, wanted: Column) -> Column:
    """25 where every entity was hit, else ten times the share, rounded half up."""
    return F.when(hits <= 0, 0.0).when(hits >= wanted, 25.0).otherwise(F.floor(10.0 * hits / wanted + 0.5).cast("double"))


def smart_priority(adaptive: Column, useful: Column, context: Column) -> Column:
    return 0.4 * adaptive + 0.3 * useful + 0.3 * context


def context_boost(similarity_sum: Column, contexts: Column, most: float = 1.2) -> Column:
    return F.when((contexts == 0) | (similarity_sum == 0), 1.0).otherwise(1 + F.least(F.lit(1.0), similarity_sum / contexts) * (most - 1))


def pattern_confidence(n: Column, vector_similarity: Column, path_similarity: Column, success: Column) -> Column:
    return F.least(F.lit(1.0), n / 5.0) * 0.3 + (vector_similarity + path_similarity) / 2 * 0.5 + success * 0.2


def quality_gate(similarity: Column, size: Column, outcome: Column, content: Column, ok: Column) -> Column:
    """auto_promote from 0.9, review from 0.7, else reject; a group that fails a critical check (``ok`` false) is rejected."""
    score = F.round(0.4 * similarity + 0.2 * size + 0.25 * outcome + 0.15 * content, 9)
    return F.when(~ok, "reject").when(score >= 0.9, "auto_promote").when(score >= 0.7, "review").otherwise("reject")


def compression_level(tokens: Column, low: int = 1500, high: int = 3000) -> Column:
    return F.when(tokens <= low, "none").when(tokens <= high, "hierarchical").otherwise("truncated")


def promoted(level: Column) -> Column:
    """The next level of an experience: a case becomes a strategy, a strategy a skill; null beyond."""
    return F.when(level == "case", "strategy").when(level == "strategy", "skill")


# How complex each intent is, what that multiplies the budget by, and each type's share of the budget.
COMPLEXITY = {"debug": "complex", "how_to": "moderate", "compare": "moderate", "configure": "moderate", "lookup": "simple", "explore": "simple"}
MULTIPLIERS = {"simple": 1.0, "moderate": 2.0, "complex": 4.0}
BUDGET_SHARES = {
    "debug": {"guideline": 0.2, "knowledge": 0.3, "tool": 0.2, "experience": 0.3},
    "how_to": {"guideline": 0.3, "knowledge": 0.25, "tool": 0.25, "experience": 0.2},
    "compare": {"guideline": 0.25, "knowledge": 0.35, "tool": 0.2, "experience": 0.2},
    "configure": {"guideline": 0.25, "knowledge": 0.25, "tool": 0.35, "experience": 0.15},
    "lookup": {"guideline": 0.2, "knowledge": 0.5, "tool": 0.15, "experience": 0.15},
    "explore": {"guideline": 0.25, "knowledge": 0.35, "tool": 0.2, "experience": 0.2},
}
BASE_BUDGET, MOST_BUDGET, RESERVE, ENTRY_TOKENS = 2000, 8000, 0.2, 200


def allocations() -> list[tuple[str, str, str, int, int]]:
    """(intent, complexity, entry_type, tokens, entries at most) of every intent and type."""
    out = []
    for intent, shares in BUDGET_SHARES.items():
        effective = int(min(BASE_BUDGET * MULTIPLIERS[COMPLEXITY[intent]], MOST_BUDGET) * (1 - RESERVE))
        out += [(intent, COMPLEXITY[intent], kind, int(effective * w), max(1, int(effective * w) // ENTRY_TOKENS)) for kind, w in shares.items()]
    return out


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (entry_type, entry_id, priority, tokens) with running and place: of each type, by priority, those whose running sum fits.

    A budget is spent after that many rows with tokens at most, so map tasks keep no more of them; the row that
    breaks the budget bounds the rows that are summed up, those without tokens included.
    """
    order = Window.partitionBy("entry_type").orderBy(F.desc("priority"), "entry_id")
    running = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    head = rows.filter("tokens > 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget + 1)
    over = head.withColumn("running", running).filter(F.col("running") > budget)
    end = over.groupBy("entry_type").agg(F.min(F.struct((-F.col("priority")).alias("p"), "entry_id")).alias("end"))
    fits = rows.join(end, "entry_type", "left").filter("end is null or -priority < end.p or (-priority = end.p and entry_id < end.entry_id)").drop("end")
    return fits.withColumn("running", running).withColumn("place", F.row_number().over(order))
