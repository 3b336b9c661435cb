"""Helpers the training-data operators share: tables, scratch tables, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path as scratch_path

#: A word is a run of anything but the six ASCII white-space characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that a lost executor can't undo."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: str) -> Column:
    """Words of a column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A lookup table is broadcast only after its rows were counted and found to be no more than this.
BROADCAST_ROWS = 100_000
SALTS = 32


def attach(left: DataFrame, lookup: DataFrame, key: str, spread: Column, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``lookup`` (one row per ``key``, null is a key like any other).

    A lookup of at most ``broadcast_rows`` rows, counted here, is broadcast. A larger one is
    copied once per salt and joined on (key, salt), so that a key with a third of all rows
    is spread over ``SALTS`` tasks. ``spread`` is any per-row value to deal out by.
    """
    null_key = f"_{key}_none"
    lookup = lookup.withColumn(null_key, F.col(key).isNull()).withColumn(key, F.coalesce(F.col(key), F.lit("")))
    left = left.withColumn(null_key, F.col(key).isNull()).withColumn(key, F.coalesce(F.col(key), F.lit("")))
    if lookup.limit(broadcast_rows + 1).count() <= broadcast_rows:
        out = left.join(F.broadcast(lookup), [key, null_key], "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        out = left.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(lookup.withColumn("_salt", salts), [key, null_key, "_salt"], "left").drop("_salt")
    return out.withColumn(key, F.when(~F.col(null_key), F.col(key))).drop(null_key)
