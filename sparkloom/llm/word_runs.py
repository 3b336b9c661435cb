"""Periodic runs of words, found by naming.

Words get numbers, equal ones the same. A name of level l stands for 2^l words from a place on, and is the pair of two
names of level l - 1, numbered anew (Karp, Miller, Rosenberg). How far two places agree is read off the names, from the
highest level down, for all pairs of places at once.

A run of period q that is long enough to count covers three periods of agreement with itself q words on, and so two full cells of the grid
of the multiples of q. Candidates are therefore the grid places whose name of 2^l <= q words is found again q words later. Each
is extended to both sides; what is long enough is a run, and of several periods of one stretch the smallest is its period. Levels
end when no name occurs twice, since no longer period can then repeat. There are at most n ln 2 candidates a level.

Defined cases: a text without words, or null, has no runs and an empty collapsed text; the length of a text has no limit, and a task
holds one text's names at a time; rows are independent, so repeated rows and ids give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE

LEAST, REPEATS = 6, 4
_WORD = re.compile(WORD_RE)


def names_of(words: list[str]) -> list[np.ndarray]:
    """Names of 1, 2, 4 ... words at each place they fit at, up to the first level where all names differ."""
    known: dict[str, int] = {}
    levels = [np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)]
    most, width = len(known), 1
    while most < len(levels[-1]) and 2 * width <= len(words):
        below = levels[-1]
        found, pairs = np.unique(below[:-width] * most + below[width:], return_inverse=True)
        levels.append(pairs.astype(np.int64))
        most, width = len(found), 2 * width
    return levels


def _agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, backward: bool) -> np.ndarray:
    """How many words from i and from j (i < j) on are equal, or, backward, how many that end before them."""
    length = np.zeros(len(i), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        names, width = levels[level], 1 << level
        a, b = (i - length - width, j - length - width) if backward else (i + length, j + length)
        fits = a >= 0 if backward else b < len(names)
        same = np.zeros(len(i), dtype=bool)
        same[fits] = names[a[fits]] == names[b[fits]]
        length += same * width
    return length


def runs(words: list[str], least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, length, period), by start, then period, of the maximal stretches of at least ``least`` words and ``repeats`` (3 or more) periods."""
    n, found = len(words), []
    levels = names_of(words) if n >= least else []
    for level, names in enumerate(levels):
        width = 1 << level
        periods = np.arange(width, min(2 * width, n // repeats + 1))
        cells = (len(names) - 1 - periods) // periods + 1  # grid places whose name, and the one a period later, fit
        periods, cells = periods[cells > 0], cells[cells > 0]
        if not len(periods):
            break
        q = np.repeat(periods, cells)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(cells) - cells, cells)) * q
        hit = names[i] == names[i + q]
        i, q = i[hit], q[hit]
        start = i - _agree(levels, i, i + q, True)
        length = i + q + _agree(levels, i, i + q, False) - start
        long = length >= np.maximum(least, repeats * q)
        found.append(np.unique(np.stack([start[long], length[long], q[long]], axis=1), axis=0))
    every = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), dtype=bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def collapsed(words: list[str], every: np.ndarray) -> list[str]:
    """The words without those that lie in a run after its first period."""
    if not len(every):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, every[:, 0] + every[:, 2], 1)
    np.add.at(change, every[:, 0] + every[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(every: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length over period, compared as whole numbers; the first of those that tie."""
    best = None
    for start, length, period in every.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def word_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), start, length, period of the strongest run or nulls, collapsed (text); (doc_id, text) are read."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                words = _WORD.findall(text or "")
                every = runs(words)
                best = strongest(every) or (None, None, None)
                listed = [dict(zip(("start", "length", "period"), r)) for r in every.tolist()]
                rows.append((doc_id, len(words), listed, *best, " ".join(collapsed(words, every))))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"])
            for c in ("doc_id", "start", "length", "period"):
                out[c] = out[c].astype("Int64")
            yield out

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(found, schema)


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, or for each tenth id by checksum the same with all words from one on repeating with a period that the checksum gives."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD_RE), F.lit(0))
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    n, g = F.greatest(F.size(words), F.lit(1)), F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) div 10")
    a = (g % n).cast("int")
    p = 1 + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    cycle = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)) > 0), changed).otherwise(F.col(text))
