"""Quality rules by weak supervision: rules vote or abstain, a label model weighs them.

Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the votes of the
rules in ``RULES``. ``kept`` is false where a base rule fails, else true if the posterior
probability of good quality reaches ``min_posterior``.

Defined cases: a null or empty text has no words, so the base rule rejects it; rows are judged
one by one, so repeated rows get the same verdict; an empty table gives an empty result; other
columns of the input are left alone (only the text is read).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import weak_supervision
from .common import SPACE_CHARS, materialize

# The window of repeated words, and words that running text in the four languages contains.
WINDOW = 8
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for was on with as be by this are or an at from "
    b"der die das und in zu den mit von ist des sich auf nicht ein eine dem im "
    b"le la les de des et en un une que est dans qui par pour pas sur "
    b"el los las y del que en un una con por para es se al".split()
)
RULES = ("symbols", "repeats", "lines", "lengths", "function_words", "capitals", "endings")
STATS = T.StructType([*(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("votes", T.StringType())])
_FINAL = re.compile(r"[.!?…][\"'»”)]*$")
_UPPER = bytes(range(65, 91))
_LETTER = bytes(range(65, 91)) + bytes(range(97, 123))


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more. Exact: windows get ranks by doubling, not hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        width += step
        order = np.argsort(pairs, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(pairs[order]) != 0)))
        if new[-1] == len(pairs) - 1:
            return 0
        rank = np.empty(len(pairs), dtype=np.int64)
        rank[order] = new
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[: len(twice)] += twice
    edge[window : window + len(twice)] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _vote(good: bool, bad: bool) -> str:
    return "b" if bad else "g" if good else "-"


def measure(text: str | None) -> tuple:
    """The statistics and votes of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return n, chars, symbols, dup_lines, repeats, "-" * len(RULES)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _LETTER))
    function = sum(map(FUNCTION_WORDS.__contains__, words))
    ended = sum(1 for x in lines if _FINAL.search(x.rstrip(SPACE_CHARS)[-8:]))
    votes = (
        _vote(symbols <= 0.02 * n, symbols > 0.1 * n),
        _vote(repeats <= 0.05 * n, repeats > 0.2 * n),
        _vote(dup_lines == 0, dup_lines > 0.3 * len(lines)),
        _vote(3 * n <= chars <= 9 * n, chars < 2 * n or chars > 14 * n),
        _vote(function >= 0.1 * n, n >= 20 and function < 0.02 * n),
        _vote(upper <= 0.15 * letters, letters >= 20 and upper > 0.4 * letters),
        _vote(ended >= 0.6 * len(lines), len(lines) >= 3 and ended < 0.2 * len(lines)),
    )
    return n, chars, symbols, dup_lines, repeats, "".join(votes)


@F.pandas_udf(STATS)
def text_stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=STATS.names)


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 20) | (100 * repeats > 30 * words)


def quality_rules(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """doc_id, the five statistics, base_failed, posterior and kept, for each row of ``docs`` (doc_id, text)."""
    stats = docs.select("doc_id", text_stats("text").alias("s")).select("doc_id", "s.*")
    stats = materialize(stats, "quality-rules")
    histogram = weak_supervision.vote_histogram(stats, "votes", len(RULES))
    model = weak_supervision.fit(histogram, len(RULES))
    spark = docs.sparkSession
    known = spark.createDataFrame([(p, model.posterior(p)) for p in sorted(histogram)], "votes string, posterior double")
    out = stats.join(F.broadcast(known), "votes", "left")  # at most 3^R rows
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("posterior") >= min_posterior)).alias("kept"),
        "posterior",
    )


def keep_good(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns. The text is read twice and never shuffled."""
    measured = docs.select(text_stats("text").alias("s")).select("s.*")
    histogram = weak_supervision.vote_histogram(measured, "votes", len(RULES))
    model = weak_supervision.fit(histogram, len(RULES))
    bad = [p for p in sorted(histogram) if model.posterior(p) < min_posterior]
    judged_docs = docs.withColumn("_qr_stats", text_stats("text"))
    return judged_docs.filter(~base_failed("_qr_stats.") & ~F.col("_qr_stats.votes").isin(bad)).drop("_qr_stats")
