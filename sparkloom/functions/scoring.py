"""Ranking and life-cycle formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights of the ranking terms.
WEIGHTS = {"relation": 50.0, "tag": 10.0, "scope": 20.0, "text": 30.0, "priority": 20.0, "semantic": 40.0, "recency": 100.0}
LN2 = math.log(2)


def decay(age_days: Column, half_life: float = 30.0, kind: str = "exponential", late_step: float = 0.5) -> Column:
    """1 at age 0, falling with age: exponential, linear to twice the half-life, or a step to ``late_step``."""
    age = F.greatest(age_days, F.lit(0.0))
    if kind == "linear":
        return F.greatest(F.lit(0.0), 1 - age / (2 * half_life))
    if kind == "step":
        return F.when(age <= half_life, 1.0).otherwise(late_step)
    return F.exp(-LN2 * age / half_life)


def recency(age_days: Column, weight: float = 0.1, half_life: float = 30.0, kind: str = "exponential") -> Column:
    return decay(age_days, half_life, kind) * weight * WEIGHTS["recency"]


def scope_term(index: Column, depth: int) -> Column:
    """Nearer scopes score more; one scope alone scores nothing."""
    return (F.lit(depth) - index) / F.lit(float(depth)) * WEIGHTS["scope"] if depth > 1 else F.lit(0.0)


def semantic_term(similarity: Column, text_score: Column | None = None, alpha: float = 0.7) -> Column:
    """No similarity scores nothing, even where the text matched."""
    blended = similarity if text_score is None else alpha * similarity + (1 - alpha) * F.coalesce(text_score, F.lit(0.0))
    return F.coalesce(WEIGHTS["semantic"] * blended, F.lit(0.0))


def feedback_multiplier(positive: Column, net: Column) -> Column:
    return F.when(net > 0, 1 + F.least(0.02 * positive, F.lit(0.1))).when(net < 0, 1 - F.least(0.1 * F.abs(net), F.lit(0.5))).otherwise(1.0)


def adaptive_weight(rate: Column, n: Column, static: float = 1.0, learning_rate: float = 0.5) -> Column:
    confidence = F.when(n < 10, 0.0).when(n >= 100, 1.0).otherwise(n / 100.0)
    learned = F.lit(static) + learning_rate * 2 * (rate - 0.5)
    return F.least(F.lit(2.0), F.greatest(F.lit(0.5), static * (1 - confidence) + learned * confidence))


def usefulness(successes: Column, n: Column, days_since: Column) -> Column:
    full = 0.5 * successes / n + 0.2 * F.exp(-LN2 * days_since / 30) + 0.3 * F.least(F.lit(1.0), n / 50.0)
    return F.when(n < 2, 0.5).otherwise(full)


def staleness(age_days: Column, access_age_days: Column, stale_age: float = 90, threshold: float = 0.2, unused: float = 60, half_life: float = 14) -> Column:
    """The first reason that holds, else null."""
    return (
        F.when(age_days > stale_age, "old_age")
        .when(decay(age_days, half_life) < threshold, "low_recency")
        .when(access_age_days > unused, "not_accessed")
    )


def forget_recency(idle_days: Column, window: float = 90) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - idle_days / window), 3)


def forget_frequency(count: Column, minimum: int = 2) -> Column:
    return F.least(F.lit(1.0), F.log(count + 1) / F.log(F.lit(10.0 * minimum + 1)))


def rank_fusion(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) * 0.25).cast("long")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def context_composite(smart: Column, relevance: Column, priority: Column) -> Column:
    return F.least(F.lit(1.0), (0.6 * smart + 0.4 * relevance) * (1 + (priority / 10.0 - 0.5) * 0.4))
