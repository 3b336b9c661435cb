"""Label model of overlapping labellers: expectation-maximisation over the histogram of vote patterns.

A labeller votes good (``g``), bad (``b``) or abstains (``-``); the votes of a row are one
string of R letters. Spark counts the patterns over all rows (at most 3^R of them, whatever
the corpus' size), so the estimate uses every row and the driver only holds the histogram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelModel:
    """``prior``: share of good rows; ``good``/``bad``: how often a labeller that votes is right on good and on bad rows."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, pattern: str) -> float:
        """Probability that a row with these votes is good. A row without votes gets the prior."""
        odds = np.log(self.prior) - np.log1p(-self.prior)
        for vote, good, bad in zip(pattern, self.good, self.bad, strict=True):
            if vote == "g":
                odds += np.log(good) - np.log1p(-bad)
            elif vote == "b":
                odds += np.log1p(-good) - np.log(bad)
        return float(1 / (1 + np.exp(-odds)))


def fit(histogram: dict[str, int], rules: int, rounds: int = 50, prior_right: float = 8.0, prior_wrong: float = 2.0) -> LabelModel:
    """EM for the accuracies and the share of good rows.

    Starts from the share of good votes in each pattern. The pseudo-counts ``prior_right`` and
    ``prior_wrong`` say that a labeller is better than chance; they fix which class is which
    and keep the estimate defined for empty tables and labellers that never vote.
    """
    patterns = sorted(histogram)
    count = np.array([histogram[p] for p in patterns], dtype=float)
    votes = np.array([[{"g": 1, "b": -1}.get(v, 0) for v in p] for p in patterns], dtype=int).reshape(len(patterns), rules)
    said_good, said_bad = (votes == 1).astype(float), (votes == -1).astype(float)
    q = (1 + said_good.sum(1)) / (2 + said_good.sum(1) + said_bad.sum(1))
    for _ in range(rounds):
        on_good, on_bad = (count * q)[:, None], (count * (1 - q))[:, None]
        good = (prior_right + (on_good * said_good).sum(0)) / (prior_right + prior_wrong + (on_good * (said_good + said_bad)).sum(0))
        bad = (prior_right + (on_bad * said_bad).sum(0)) / (prior_right + prior_wrong + (on_bad * (said_good + said_bad)).sum(0))
        prior = (prior_right + (count * q).sum()) / (prior_right + prior_wrong + count.sum())
        odds = np.log(prior) - np.log1p(-prior)
        odds = odds + said_good @ (np.log(good) - np.log1p(-bad)) + said_bad @ (np.log1p(-good) - np.log(bad))
        q = 1 / (1 + np.exp(-odds))
    return LabelModel(float(prior), tuple(good.tolist()), tuple(bad.tolist()))


def vote_histogram(votes: DataFrame, column: str, rules: int) -> dict[str, int]:
    """Counts of the patterns in ``column``; pre-aggregated in each task, at most 3^rules rows reach the driver."""
    return {r[0]: r[1] for r in votes.groupBy(column).agg(F.count(F.lit(1))).collect() if r[0] is not None and len(r[0]) == rules}
