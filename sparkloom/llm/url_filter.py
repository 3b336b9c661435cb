"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A URL is expanded into every (host suffix, path prefix) that a rule could have, with path
prefixes of the lengths that rules have. Expressions meet rules in an equi-join on the first
``prefix_digits`` hex digits of the SHA-256; the full digest confirms. Of the rules that fit,
the longest wins (then the longer host, then block before allow).

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets
``default``; repeated rows are judged alike (each distinct host and path is judged once); empty
tables of urls or rules work; urls and rules may be of any length; a rule without host or path fits nothing; other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: str) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url))))


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def host_suffixes(host: Column) -> Column:
    """The host and every suffix of it that starts after a dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url); ``rules``: host, path, action."""
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    # one short list, whatever the number of urls and rules: the distinct lengths that rule paths have
    lengths = sorted(r[0] for r in rules.filter("rule_path is not null").select(F.length("rule_path")).distinct().collect())
    rules = rules.withColumn("full", F.sha2(expression(F.col("rule_host"), F.col("rule_path")), 256)).withColumn("short", F.substring("full", 1, prefix_digits))

    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    places = rows.filter("host <> ''").select("host", "path").distinct()
    within = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(within, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (
        places.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("h"))
        .select("host", "path", "h", F.explode(prefixes).alias("p"))
        .select("host", "path", F.sha2(expression(F.col("h"), F.col("p")), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, prefix_digits))
    )
    rank = F.struct(
        F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.when(F.col("action") == "block", 1).otherwise(0),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("action"),
    )
    fits = expanded.join(rules, "short").filter(F.col("digest") == F.col("full"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # Rows without a host fit no rule and never meet; those of one hot url are one row on the right, which skewed joins copy.
    judged = rows.filter("host <> ''").join(best, ["host", "path"], "left").unionByName(rows.filter("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
