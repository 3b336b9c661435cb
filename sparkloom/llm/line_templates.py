"""Line deduplication by a log-template tree.

A line is parsed down a tree of fixed depth: its token count, then its leading tokens (tokens with
a digit, an address or a link in them are variable and read ``<*>``). The tokens after those are dealt into
``FIELDS`` fields. A leaf holds templates: the line with all but ``KEPT`` of its fields generalised to ``<*>``, one for each
choice of fields. So lines of one path that differ in variable tokens, or in up to FIELDS - KEPT fields, share
a template; what they share is then half of their tokens at least, in place. A line of fewer than ``MIN_GENERAL`` tokens
is its own only template, and one of fewer than ``MIN_MASKED`` is so with its variable tokens as they are.

A template that recurs across documents is dropped: the document with the smallest doc_id keeps its
lines, every other document loses them.

A template travels as a 96-bit digest; the digests are written once and read twice. Finding a template's first document is a minimum that each map task
combines first, so a line that a third of all documents contain costs one row per task there; the
join back to the documents' lines is one that Spark splits where it is skewed.

Defined cases: null and empty texts have no lines and pass unchanged; lines without tokens
are never dropped; rows with equal doc_id are one document, so a line that only they
share stays; rows without doc_id lose what a row with doc_id has, and keep what only such rows
share; an empty table works; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

LEADING = 1
FIELDS, KEPT = 4, 2
MIN_MASKED = 4
MIN_GENERAL = 16
CHOICES = tuple(combinations(range(FIELDS), KEPT))
VARIABLE = b"<*>"
_VARIABLE = re.compile(rb"[0-9@]|://|www\.")
ROWS = "doc_id long, salt long, high long, low int"


def templates(line: str) -> list[bytes]:
    """Digests of the templates that one line belongs to; none for a line without tokens."""
    raw = line.encode("utf-8", "surrogatepass").lower()
    tokens = raw.split()
    n = len(tokens)
    if not n:
        return []
    if n < MIN_MASKED:
        return [xxhash.xxh3_128_digest(b"%d\0%s" % (n, b" ".join(tokens)))[:12]]
    if _VARIABLE.search(raw):
        tokens = [VARIABLE if _VARIABLE.search(t) else t for t in tokens]
    path = b"%d\0%s\0" % (n, b" ".join(tokens[:LEADING]))
    rest = tokens[LEADING:]
    if n < MIN_GENERAL:
        return [xxhash.xxh3_128_digest(path + b" ".join(rest))[:12]]
    cuts = [k * len(rest) // FIELDS for k in range(FIELDS + 1)]
    fields = [b" ".join(rest[at:to]) for at, to in zip(cuts, cuts[1:])]
    return [xxhash.xxh3_128_digest(b"%s%d %d\0%s\0%s" % (path, i, j, fields[i], fields[j]))[:12] for i, j in CHOICES]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and template in it."""
    for batch in batches:
        counts, found = [], []
        for text in batch.column(2).to_pylist():
            own = {t for line in (text or "").split("\n") for t in templates(line)}
            counts.append(len(own))
            found += own
        digest = np.frombuffer(b"".join(found), dtype=[("high", "<i8"), ("low", "<i4")])
        of = np.repeat(np.arange(len(counts)), counts)
        yield pa.record_batch([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(digest["high"]), pa.array(digest["low"])], ["doc_id", "salt", "high", "low"])


def _salt() -> Column:
    """Tells rows without doc_id apart; 0 for the others."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
def _without(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    out = []
    for text, gone in zip(texts, dropped, strict=True):
        if text is None or gone is None:
            out.append((text, text.count("\n") + 1 if text else 0, 0))
            continue
        lines, bad = text.split("\n"), set(gone.tolist())
        kept = [x for x in lines if not any(int.from_bytes(t[:8], "little", signed=True) in bad for t in templates(x))]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def recurring(docs: DataFrame) -> DataFrame:
    """doc_id, salt, gone (digests): for each document the templates that an earlier document has."""
    rows = materialize(docs.select("doc_id", _salt().alias("salt"), "text").mapInArrow(_parsed, ROWS), "line-templates")
    found = rows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    first = found.filter("first < last or (unnamed and first is not null)").select("high", "low", "first")
    later = rows.join(first.hint("merge"), ["high", "low"]).filter("doc_id is null or doc_id > first")
    return later.groupBy("doc_id", "salt").agg(F.collect_set("high").alias("gone"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with recurring lines removed from text, and n_lines, n_dropped in a struct ``_lines``."""
    gone = recurring(docs).select(F.col("doc_id").alias("_lt_id"), F.col("salt").alias("_lt_salt"), "gone")
    keyed = docs.withColumn("_lt_own", _salt())
    same = keyed["doc_id"].eqNullSafe(gone["_lt_id"]) & (keyed["_lt_own"] == gone["_lt_salt"])
    both = keyed.join(gone.hint("merge"), same, "left")
    cut = both.withColumn("_lines", _without(keyed["text"], gone["gone"]))
    return cut.select(*[F.col("_lines.text").alias(c) if c == "text" else keyed[c] for c in docs.columns], "_lines")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines removed, same columns; n_chars follows the text where there is one."""
    out = drop_recurring_lines(docs).drop("_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
