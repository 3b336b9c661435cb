"""Gapless numbers for the rows of a table in a stated order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

_PLACE = (1 << 33) - 1


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with _rank: 0, 1, 2 ... in the order of the columns ``order``, nulls first; rows that tie follow each other in any order.

    The rows are written, range-sorted, and numbered inside each range; the ranges' sizes, one row each, give where
    a range begins. A running number of the written rows is the last thing sorted by, so that rows which
    tie can be cut into several ranges.
    """
    written = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), label)
    by = [*order, "_tie"]
    dealt = written.repartitionByRange(parallelism(rows.sparkSession), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    placed = materialize(dealt.select(*rows.columns, F.spark_partition_id().alias("_part"), place.alias("_place")), label)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # as many rows as there are ranges
    begins = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_begin"))
    return placed.join(F.broadcast(begins), "_part").select(*rows.columns, (F.col("_begin") + F.col("_place")).alias("_rank"))
