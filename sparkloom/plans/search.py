"""The retrieval plan: one parameter object, one lazy DataFrame."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import feedback, filters, policies, scope
from ..operators.graph import cut

DEFAULT_LIMIT, MAX_LIMIT = 20, 100


@dataclass(frozen=True)
class SearchPlan:
    """What to look for. Unset fields do not filter."""

    types: tuple[str, ...] = ("tool", "guideline", "knowledge", "experience")
    search: str | None = None
    tags_include: tuple[str, ...] = ()
    tags_require: tuple[str, ...] = ()
    tags_exclude: tuple[str, ...] = ()
    born_after_h: int | None = None
    born_before_h: int | None = None
    priority: tuple[int | None, int | None] = (None, None)
    include_inactive: bool = False
    recency_weight: float = 0.1
    half_life_days: float = 30.0
    decay: str = "exponential"
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    semantic: bool = False
    related: bool = False
    conversation: bool = False
    semantic_threshold: float | None = None
    relation_depth: int | None = None
    extra: dict = field(default_factory=dict)

    def bounded_limit(self) -> int:
        return max(1, min(MAX_LIMIT, int(self.limit)))

    def strategy(self) -> str:
        """The first that applies names the plan."""
        checks = (
            ("semantic", self.semantic), ("relation", self.related), ("tag", self.tags_include or self.tags_require or self.tags_exclude),
            ("date", self.born_after_h is not None or self.born_before_h is not None), ("priority", self.priority != (None, None)),
            ("conversation", self.conversation), ("text", (self.search or "").strip()),
        )
        return next((name for name, on in checks if on), "default")

    def cost(self) -> str:
        """How much work the plan is: vectors are the most, then relations and many required tags."""
        return "high" if self.semantic else "medium" if self.related or len(self.tags_require) > 2 else "low"

    def problems(self) -> list[str]:
        """What a dry run reports."""
        out = []
        if not 1 <= self.limit <= 1000:
            out.append("limit must be 1 to 1000")
        if self.offset < 0:
            out.append("offset must not be negative")
        if self.semantic_threshold is not None and not 0 <= self.semantic_threshold <= 1:
            out.append("semantic threshold must be 0 to 1")
        if self.relation_depth is not None and self.relation_depth > 10:
            out.append("relation depth must be 10 at most")
        unknown = set(self.types) - {"tool", "guideline", "knowledge", "experience"}
        return out + [f"unknown type {t}" for t in sorted(unknown)]


def candidates(plan: SearchPlan, entries: DataFrame, tags: DataFrame, chain: DataFrame) -> DataFrame:
    """Entries that pass every filter, with place and include_hits."""
    out = entries if plan.include_inactive else entries.filter("is_active")
    out = out.filter(F.col("entry_type").isin(*plan.types))
    out = out.filter(filters.in_range(F.col("born_h"), plan.born_after_h, plan.born_before_h))
    if plan.priority != (None, None):
        out = out.filter((F.col("entry_type") != "guideline") | filters.in_range(F.col("priority"), *plan.priority))
    rest, words, phrases = text.parse_exclusions(plan.search or "")
    if rest:
        out = out.filter(text.contains(F.col("title"), rest))
    if words or phrases:
        out = out.filter(~text.excluded(F.col("title"), words, phrases))
    out = scope.in_scope(out, chain)
    if plan.tags_include or plan.tags_require or plan.tags_exclude:
        return filters.tags_filter(out, tags, plan.tags_include, plan.tags_require, plan.tags_exclude)
    return out.withColumn("include_hits", F.lit(0))


def score(plan: SearchPlan, found: DataFrame, depth: int, as_of_h: int) -> DataFrame:
    rest = text.parse_exclusions(plan.search or "")[0]
    age = (F.lit(as_of_h) - F.col("born_h")) / 24.0
    total = (
        F.col("include_hits") * scoring.WEIGHTS["tag"]
        + scoring.scope_term(F.col("place"), depth)
        + F.lit(scoring.WEIGHTS["text"] if rest else 0.0)
        + F.when(F.col("entry_type") == "guideline", F.col("priority") * (scoring.WEIGHTS["priority"] / 100)).otherwise(0.0)
        + scoring.recency(age, plan.recency_weight, plan.half_life_days, plan.decay)
    )
    return found.withColumn("score", F.round(total, 6))


def search(plan: SearchPlan, entries: DataFrame, tags: DataFrame, chain: DataFrame, depth: int, as_of_h: int) -> DataFrame:
    """The top entries: score descending, then newer, then smaller id; offset applies."""
    ranked = score(plan, candidates(plan, entries, tags, chain), depth, as_of_h)
    top = ranked.orderBy(F.desc("score"), F.desc("born_h"), "entry_id")
    return top.offset(plan.offset).limit(plan.bounded_limit())


@dataclass(frozen=True)
class Signals:
    """What other searches found; unset ones neither find nor score anything.

    ``text``: entry_id, fts (0 to 1); ``similar``: entry_id, sim; ``related``: entry_id; ``outcomes``: entry_id, outcome.
    """

    text: DataFrame | None = None
    similar: DataFrame | None = None
    related: DataFrame | None = None
    outcomes: DataFrame | None = None
    intent: str = "explore"


def search_all(plan: SearchPlan, signals: Signals, entries: DataFrame, tags: DataFrame, chain: DataFrame, depth: int, as_of_h: int) -> DataFrame:
    """The top entries by all signals: entries that full text or similarity finds, if either is given, and that pass every filter.

    Two phases, each a bounded top-k: the light score picks one and a half times the limit, the full score with recency, similarity,
    feedback and the intent's weight for the type orders those. Only the picked entries' feedback is looked at.
    """
    found = candidates(plan, entries, tags, chain).drop("content")
    none = F.lit(None).cast("double")
    found = found.join(signals.text, "entry_id", "left") if signals.text is not None else found.withColumn("fts", none)
    found = found.join(signals.similar, "entry_id", "left") if signals.similar is not None else found.withColumn("sim", none)
    if signals.text is not None or signals.similar is not None:
        found = found.filter("fts is not null or sim is not null")
    near = F.lit(False)
    if signals.related is not None:
        found = found.join(signals.related.select("entry_id", F.lit(True).alias("near")).distinct(), "entry_id", "left")
        near = F.coalesce("near", near)
    matched = F.col("fts").isNotNull() | F.lit(bool(text.parse_exclusions(plan.search or "")[0]))
    base = (
        F.when(near, scoring.WEIGHTS["relation"]).otherwise(0.0)
        + F.col("include_hits") * scoring.WEIGHTS["tag"]
        + scoring.scope_term(F.col("place"), depth)
        + F.when(matched, scoring.WEIGHTS["text"]).otherwise(0.0)
        + F.when(F.col("entry_type") == "guideline", F.col("priority") * (scoring.WEIGHTS["priority"] / 100)).otherwise(0.0)
    )
    light = F.round(base + scoring.WEIGHTS["text"] * F.coalesce("fts", F.lit(0.0)), 6)
    head = found.withColumn("base", base).withColumn("light_score", light).orderBy(F.desc("light_score"), "entry_id")
    head = cut(head.limit(math.ceil(1.5 * (plan.offset + plan.bounded_limit()))), "search")
    age = (F.lit(as_of_h) - F.col("born_h")) / 24.0
    total = F.col("base") + scoring.semantic_term(F.col("sim"), F.col("fts")) + scoring.recency(age, plan.recency_weight, plan.half_life_days, plan.decay)
    factor = policies.intent_weight(signals.intent, F.col("entry_type"))
    if signals.outcomes is not None:
        picked = F.broadcast(head.select("entry_id").distinct())  # one and a half times the limit and offset
        head = head.join(feedback.net_feedback(signals.outcomes.join(picked, "entry_id", "left_semi")), "entry_id", "left")
        factor = factor * scoring.feedback_multiplier(F.coalesce("positive", F.lit(0)), F.coalesce("net", F.lit(0)))
    top = head.withColumn("score", F.round(total * factor, 6)).orderBy(F.desc("score"), F.desc("born_h"), "entry_id")
    return top.offset(plan.offset).limit(plan.bounded_limit())
