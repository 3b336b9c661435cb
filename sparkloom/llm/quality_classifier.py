"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every text; expectation-maximisation over all rows
estimates how often each is right, and the posterior probability of good quality is the training
label of a linear scorer over hashed features (words, word shapes and repetitions). The scorer then judges
every row by its words alone.

The scorer is fitted on a bounded sample: the ``max_training_docs`` distinct texts with the smallest hash, each
once, however many copies it has. Labellers' statistics, their estimate and the scores cover all rows.

Defined cases: null and empty texts have no votes and no features, so they score the bias and are not kept;
rows are judged one by one, so repeated rows agree; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import weak_supervision
from .common import materialize
from .quality_rules import RULES, text_stats

FEATURES = 1 << 15
MAX_TRAINING_DOCS = 6000
CACHE_WORDS = 400_000
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
_known: dict[bytes, tuple[int, int]] = {}


def _bucket(kind: bytes, value: bytes) -> int:
    return zlib.crc32(kind + value) % FEATURES


def _word(word: bytes) -> tuple[int, int]:
    """Buckets of a word's lower case and of its shape."""
    found = _known.get(word)
    if found is None:
        if len(_known) > CACHE_WORDS:
            _known.clear()
        shape = word
        for pattern, letter in _SHAPES:
            shape = pattern.sub(letter, shape)
        found = _known[word] = (_bucket(b"w", word.lower()), _bucket(b"s", shape))
    return found


REPEAT, FRESH = _bucket(b"r", b"again"), _bucket(b"r", b"new")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): shares of words, shapes and immediate repetitions; empty for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    buckets = np.array([_word(w) for w in words], dtype=np.int32).ravel()
    again = len(words) - len(set(words))
    buckets, counts = np.unique(buckets, return_counts=True)
    values = np.sqrt(counts / len(words))
    extra = np.array([again, len(words) - again]) / len(words)
    return np.append(buckets, [REPEAT, FRESH]).astype(np.int32), np.append(values, np.sqrt(extra)).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([b for b, _ in both], pa.list_(pa.int32())), pa.array([v for _, v in both], pa.list_(pa.float32()))], ["posterior", "buckets", "features"])


def train(posterior: np.ndarray, buckets: list, values: list, rounds: int = 150, rate: float = 1.0, l2: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic fit to the posteriors, by full-batch AdaGrad."""
    weights = np.zeros(FEATURES + 1)
    if not len(posterior):
        return weights
    cols, vals = np.concatenate(buckets).astype(np.int64), np.concatenate(values).astype(float)
    rows = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    past = np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        margin = np.bincount(rows, weights=weights[cols] * vals, minlength=len(posterior)) + weights[-1]
        miss = (1 / (1 + np.exp(-margin)) - posterior) / len(posterior)
        grad = np.append(np.bincount(cols, weights=miss[rows] * vals, minlength=FEATURES), miss.sum()) + l2 * weights
        past += grad * grad
        weights -= rate * grad / np.sqrt(past)
    return weights


def _scored(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins, counts = [], []
            for text in batch.column(1).to_pylist():
                b, v = features(text)
                margins.append(float(weights[b] @ v + weights[-1]))
                counts.append(len(b))
            score = 1 / (1 + np.exp(-np.array(margins)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array(np.array(counts) > 0)], ["doc_id", "score", "words"])

    return run


def quality_classifier(docs: DataFrame, min_score: float = 0.5, max_training_docs: int = MAX_TRAINING_DOCS) -> DataFrame:
    """doc_id, score, kept for each row of ``docs`` (doc_id, text)."""
    key = F.xxhash64("text")
    votes = materialize(docs.select(key.alias("row_key"), text_stats("text")["votes"].alias("votes")), "classifier-votes")
    histogram = weak_supervision.vote_histogram(votes, "votes", len(RULES))
    model = weak_supervision.fit(histogram, len(RULES))
    spark = docs.sparkSession
    known = spark.createDataFrame([(p, model.posterior(p)) for p in sorted(histogram)], "votes string, posterior double")
    distinct = votes.groupBy("row_key").agg(F.min("votes").alias("votes"))
    sample = distinct.orderBy("row_key").limit(max_training_docs).join(F.broadcast(known), "votes")
    # copies of a text collapse in each map task, so the driver gets max_training_docs rows at most
    picked = docs.select(key.alias("row_key"), "text").join(F.broadcast(sample), "row_key").groupBy("row_key").agg(F.min("posterior").alias("posterior"), F.min("text").alias("text"))
    rows = picked.select("posterior", "text").mapInArrow(_featured, "posterior double, buckets array<int>, features array<float>")
    got = rows.toPandas()
    # order by content, so that reruns fit the same weights
    got = got.assign(order=[zlib.crc32(b.tobytes()) if isinstance(b, np.ndarray) else 0 for b in got["buckets"]]).sort_values(["order", "posterior"]) if len(got) else got
    weights = train(got["posterior"].to_numpy(dtype=float), list(got["buckets"]), list(got["features"]))
    scored = docs.select("doc_id", "text").mapInArrow(_scored(weights), "doc_id long, score double, words boolean")
    return scored.select("doc_id", "score", (F.col("words") & (F.col("score") >= min_score)).alias("kept"))
