import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import word_runs
from sparkloom.llm.queries import QUERIES


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[k] == words[k - q] for k in range(q, len(words))))


def brute(words):
    """All runs by trying every period and stretch."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(6, 4 * q) and smallest_period(words[s:e]) == q:
                out.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=70))
def test_runs_equal_brute_force(words):
    assert [tuple(r) for r in word_runs.runs(words).tolist()] == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=1, max_size=7), st.integers(4, 9), st.lists(st.sampled_from("abx"), max_size=20), st.lists(st.sampled_from("abx"), max_size=20))
def test_planted_runs_equal_brute_force(cycle, times, before, after):
    words = before + cycle * times + after
    assert [tuple(r) for r in word_runs.runs(words).tolist()] == brute(words)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text, find):
    words = planted(doc_id, text)
    runs = find(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


def got(df):
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))


def test_query_equals_brute_force(spark, data):
    """Texts of up to 600 words by trying all stretches, longer ones by the operator's own runs."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fast = lambda words: brute(words) if len(words) < 600 else [tuple(r) for r in word_runs.runs(words).tolist()]
    found = QUERIES["op13_word_runs"](spark, data)
    assert got(found) == sorted(repr(expected(d, t, fast)) for d, t in docs)
    assert found.filter("n_runs > 0").count() > 5


def test_edge_rows(spark, tmp_path, clashing, edge_rows):
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    fast = lambda words: [tuple(r) for r in word_runs.runs(words).tolist()]
    assert got(QUERIES["op13_word_runs"](spark, str(tmp_path))) == sorted(repr(expected(r[0], r[1], fast)) for r in edge_rows)


def test_empty_table(spark, empty_docs):
    assert word_runs.word_runs(empty_docs).collect() == []


def test_long_texts(spark):
    """Repeated throughout, random, and with one long period."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(5000)}" for _ in range(50_000)]
    assert word_runs.runs(["a"] * 100_000).tolist() == [[0, 100_000, 1]]
    assert word_runs.runs(base * 5).tolist() == [[0, 250_000, 50_000]]
    assert word_runs.runs(base).tolist() == []
    rows = spark.createDataFrame([(1, " ".join(base * 4))], "doc_id long, text string")
    found = word_runs.word_runs(rows).first()
    assert found["runs"][0].asDict() == {"start": 0, "length": 200_000, "period": 50_000} and found["collapsed"] == " ".join(base)


def test_strongest_is_compared_exactly():
    import numpy as np

    assert word_runs.strongest(np.array([[0, 8, 2], [9, 12, 3], [30, 13, 3]])) == (30, 13, 3)
    assert word_runs.strongest(np.array([[0, 8, 2], [9, 12, 3]])) == (0, 8, 2)
    assert word_runs.strongest(np.zeros((0, 3), dtype=int)) is None
