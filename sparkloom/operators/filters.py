"""Row predicates of retrieval: tags, dates, validity, priority, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tags_filter(entries: DataFrame, tags: DataFrame, include: tuple = (), require: tuple = (), exclude: tuple = ()) -> DataFrame:
    """Any of ``include``, all of ``require``, none of ``exclude``, without case. Untagged entries pass an exclusion."""
    wanted = [t.lower() for t in (*include, *require, *exclude)]
    hits = tags.select("entry_id", F.lower("tag").alias("tag")).filter(F.col("tag").isin(wanted)).groupBy("entry_id").agg(F.collect_set("tag").alias("_hits"))
    out = entries.join(hits, "entry_id", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<string>")))
    lower = lambda xs: F.array(*[F.lit(x.lower()) for x in xs])
    if include:
        out = out.filter(F.arrays_overlap("_hits", lower(include)))
    if require:
        out = out.filter(F.size(F.array_except(lower(require), F.col("_hits"))) == 0)
    if exclude:
        out = out.filter(~F.arrays_overlap("_hits", lower(exclude)))
    return out.withColumn("include_hits", F.size(F.array_intersect("_hits", lower(include))) if include else F.lit(0)).drop("_hits")


def in_range(value: Column, low: object | None = None, high: object | None = None) -> Column:
    """Inclusive at both ends; null passes only where there is no bound."""
    if low is None and high is None:
        return F.lit(True)
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    return ok & (value <= high) if high is not None else ok


def valid_at(at: int, start: Column, stop: Column) -> Column:
    """Half-open; null is unbounded."""
    return (start.isNull() | (start <= at)) & (stop.isNull() | (stop > at))


def valid_during(first: int, last: int, start: Column, stop: Column) -> Column:
    """Overlap with a closed interval."""
    return (start.isNull() | (start <= last)) & (stop.isNull() | (stop >= first))


def current_version(versions: DataFrame) -> DataFrame:
    """The highest version of each entry, by one map-side combined maximum."""
    others = [c for c in versions.columns if c not in ("entry_id", "version_num")]
    best = versions.groupBy("entry_id").agg(F.max(F.struct("version_num", *others)).alias("v"))
    return best.select("entry_id", "v.*")
