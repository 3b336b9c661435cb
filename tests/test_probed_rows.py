"""Queries and their cells leave a task some at a time."""

import numpy as np
import pandas as pd

from sparkloom.operators import vector_index


class Taken:
    """Stands for a table of queries and keeps the frames that a task gives."""

    def __init__(self, frame):
        self.frame = frame

    def mapInPandas(self, function, schema):
        return list(function(iter([self.frame])))


def test_a_task_asks_bounded_rows_at_a_time():
    rng = np.random.default_rng(4)
    cells, n = 512, 1000
    books = vector_index._Books(rng.normal(size=(cells, 8)).astype(np.float32), np.zeros((2, 1, 4), dtype=np.float32))
    index = vector_index.Index("", 8, cells, 2, 1000, 4, 10, 1.0, "")
    frame = pd.DataFrame({"query_id": np.arange(n), "q": list(rng.normal(size=(n, 8))), "least": -1.0})
    frames = vector_index._probed(Taken(frame), index, books, np.full(cells, 3.2))
    assert max(map(len, frames)) <= 65_536 and sum(map(len, frames)) == n * cells
    assert pd.concat(frames).groupby("query_id").size().eq(cells).all()
