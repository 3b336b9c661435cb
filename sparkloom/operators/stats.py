"""Aggregates that several analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def when_count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def top(counts: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n largest, ties in the order of the named columns."""
    return counts.orderBy(F.desc(by), *ties).limit(n)


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at rank floor(n * share) of the sorted column.

    Ranks are found by counting distinct values, not by sorting rows into one task: the running count over
    value groups is a window over at most as many rows as there are distinct values in a bucket.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.min(column), F.max(column), F.sum("n")).first()
    spark = values.sparkSession
    if bounds[2] is None:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(k) for k in shares])
    low, high, total = bounds
    width = (high - low) / 1000 or 1.0
    bucketed = counts.withColumn("bucket", F.floor((F.col(column) - low) / width).cast("long"))
    sizes = dict(bucketed.groupBy("bucket").agg(F.sum("n")).collect())  # 1001 buckets at most
    out = {}
    for name, share in shares.items():
        rank, before = min(int(total * share), total - 1), 0
        for bucket in sorted(sizes):
            if before + sizes[bucket] > rank:
                break
            before += sizes[bucket]
        from pyspark.sql import Window

        inner = bucketed.filter(F.col("bucket") == bucket).withColumn("upto", F.sum("n").over(Window.partitionBy("bucket").orderBy(column)))
        out[name] = inner.filter(F.col("upto") > rank - before).agg(F.min(column)).first()[0]
    return spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in out.items()])
