"""Scopes: chain resolution, scoped scans, permission filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_chains(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """(session_id, place, scope_type, scope_id): from each session up to global; missing parents stay as null ids."""
    joined = sessions.join(projects, "project_id", "left")
    chain = F.array(
        F.struct(F.lit("session").alias("scope_type"), F.col("session_id").alias("scope_id")),
        F.struct(F.lit("project").alias("scope_type"), F.col("project_id").alias("scope_id")),
        F.struct(F.lit("org").alias("scope_type"), F.col("org_id").alias("scope_id")),
        F.struct(F.lit("global").alias("scope_type"), F.lit(None).cast("long").alias("scope_id")),
    )
    return joined.select("session_id", F.posexplode(chain).alias("place", "s")).select("session_id", "place", "s.scope_type", "s.scope_id")


def in_scope(entries: DataFrame, chain: DataFrame) -> DataFrame:
    """Entries whose scope is in the chain (place, scope_type, scope_id: a handful of rows), with its place."""
    c = F.broadcast(chain.select("place", F.col("scope_type").alias("_type"), F.col("scope_id").alias("_id")))  # four rows at most: one chain
    return entries.join(c, (F.col("scope_type") == F.col("_type")) & F.col("scope_id").eqNullSafe(F.col("_id"))).drop("_type", "_id")


def nearest_per_key(scoped: DataFrame, *keys: str) -> DataFrame:
    """The row of the nearest scope for each key; ties go to the smallest entry_id."""
    best = scoped.groupBy(*keys).agg(F.min(F.struct("place", "entry_id")).alias("_best"))
    return scoped.join(best, list(keys)).filter((F.col("place") == F.col("_best.place")) & (F.col("entry_id") == F.col("_best.entry_id"))).drop("_best")


def permitted(entries: DataFrame, grants: DataFrame, level: str = "read") -> DataFrame:
    """Entries that a grant of at least ``level`` (read < write < admin) on their scope type covers."""
    order = {"read": 1, "write": 2, "admin": 3}
    rank = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in order.items()])
    return entries.join(grants.filter(rank >= order[level]).select("scope_type").distinct(), "scope_type", "left_semi")
