import math
import random
import re
import zlib
from collections import Counter

import pytest

from sparkloom.llm import quality_classifier, quality_rules, weak_supervision

SPACE = " \t\n\x0b\x0c\r"


def slow_repeats(words, window=8):
    found = {}
    for k in range(len(words) - window + 1):
        found.setdefault(tuple(words[k : k + window]), []).append(k)
    return len({k + d for places in found.values() if len(places) > 1 for k in places for d in range(window)})


def test_repeated_words_against_brute_force():
    rnd = random.Random(1)
    for n in list(range(0, 30)) + [100, 300]:
        for letters in (1, 2, 5, 50):
            words = [str(rnd.randrange(letters)) for _ in range(n)]
            words += words[: n // 2]
            assert quality_rules.repeated_words(words) == slow_repeats(words)


def test_statistics_against_brute_force(spark, edge_docs, data):
    rows = quality_rules.quality_rules(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        lines = r["text"].split("\n")
        dup = sum(1 for k, x in enumerate(lines) if x.strip(SPACE) and x in lines[:k])
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r["text"])), dup, slow_repeats(words))
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert g["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g["kept"] and g["base_failed"])


def test_edges(spark, edge_docs, clashing, empty_docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_rules(clashing).collect()}
    assert got[(2, 0)]["base_failed"] and not got[(2, 0)]["kept"]
    assert got[(4, 60_000)]["n_words"] == 60_000
    assert quality_rules.quality_rules(empty_docs).count() == 0
    assert quality_rules.keep_good(empty_docs).count() == 0
    assert quality_rules.keep_good(clashing).columns == clashing.columns
    out = quality_classifier.quality_classifier(clashing).collect()
    assert len(out) == clashing.count()
    assert not any(r["kept"] for r in out if r["doc_id"] in (2, 3, 5))
    assert quality_classifier.quality_classifier(empty_docs).count() == 0


def test_keep_good_agrees_with_the_verdicts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r[0] for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    assert kept == {r[0] for r in quality_rules.quality_rules(docs).filter("kept").select("doc_id").collect()}


def test_label_model_recovers_planted_accuracies():
    rnd = random.Random(5)
    right = [0.95, 0.85, 0.75, 0.6, 0.9]
    votes, truth = [], []
    for _ in range(8000):
        good = rnd.random() < 0.7
        truth.append(good)
        votes.append("".join("-" if rnd.random() < 0.3 else ("g" if (rnd.random() < p) == good else "b") for p in right))
    histogram = {}
    for v in votes:
        histogram[v] = histogram.get(v, 0) + 1
    model = weak_supervision.fit(histogram, 5)
    assert model.prior == pytest.approx(0.7, abs=0.05)
    for p, g in zip(right, model.good, strict=True):
        assert g == pytest.approx(p, abs=0.07)
    hits = sum((model.posterior(v) >= 0.5) == t for v, t in zip(votes, truth, strict=True))
    assert hits / len(votes) > 0.9
    empty = weak_supervision.fit({}, 3)
    assert 0 < empty.posterior("---") < 1


@pytest.mark.parametrize("operator", ["classifier", "rules"])
def test_held_out_accuracy_on_labels(spark, operator):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = quality_classifier.quality_classifier(docs) if operator == "classifier" else quality_rules.quality_rules(docs).filter("not base_failed")
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97
    if bad:
        assert 1 - sum(bad) / len(bad) > 0.8


def test_classifier_is_the_same_twice(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a = {r["doc_id"]: round(r["score"], 9) for r in quality_classifier.quality_classifier(docs).collect()}
    assert a == {r["doc_id"]: round(r["score"], 9) for r in quality_classifier.quality_classifier(docs.repartition(7)).collect()}




def slow_model(votes, rules=7, rounds=50):
    """The label model row by row, in plain loops."""
    q = [(1 + v.count("g")) / (2 + v.count("g") + v.count("b")) for v in votes]
    for _ in range(rounds):
        good, bad = [], []
        for k in range(rules):
            said = [(p, v[k]) for p, v in zip(q, votes, strict=True) if v[k] != "-"]
            good.append((8 + sum(p for p, x in said if x == "g")) / (10 + sum(p for p, _ in said)))
            bad.append((8 + sum(1 - p for p, x in said if x == "b")) / (10 + sum(1 - p for p, _ in said)))
        prior = (8 + sum(q)) / (10 + len(q))
        chance = lambda v: prior * math.prod(g if x == "g" else 1 - g for x, g in zip(v, good, strict=True) if x != "-")
        other = lambda v: (1 - prior) * math.prod(b if x == "b" else 1 - b for x, b in zip(v, bad, strict=True) if x != "-")
        q = [chance(v) / (chance(v) + other(v)) for v in votes]
    return q


def test_verdicts_against_brute_force(spark, edge_docs, data):
    """Posterior and verdict of every row against the label model run row by row."""
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(edge_docs)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    votes = [quality_rules.measure(t)[-1] for _, t in texts]
    want = sorted((str(d), p) for (d, _), p in zip(texts, slow_model(votes), strict=True))
    rows = quality_rules.quality_rules(docs).collect()
    got = sorted((str(r["doc_id"]), r["posterior"]) for r in rows)
    assert [d for d, _ in got] == [d for d, _ in want] and [p for _, p in got] == pytest.approx([p for _, p in want], abs=1e-6)
    assert all(r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5) for r in rows)


def slow_features(text):
    words = (text or "").split()
    bags = Counter()
    for w in words:
        shape = re.sub("[0-9]+", "0", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", w)))
        bags[zlib.crc32(b"w" + w.lower().encode()) % quality_classifier.FEATURES] += 1
        bags[zlib.crc32(b"s" + shape.encode()) % quality_classifier.FEATURES] += 1
    out = [(k, math.sqrt(n / len(words))) for k, n in sorted(bags.items())]
    again = (len(words) - len(set(words))) / max(1, len(words))
    return out + [(quality_classifier.REPEAT, math.sqrt(again)), (quality_classifier.FRESH, math.sqrt(1 - again))] if words else []


def test_classifier_against_brute_force(spark):
    """Votes, posteriors, features, fit and scores in plain loops over a small table."""
    rnd = random.Random(6)
    good = [" ".join(rnd.choice("the of and house river stone paper light water".split()) for _ in range(40)) + "." for _ in range(14)]
    bad = [" ".join(rnd.choice(["BUY", "$$$", "NOW", "##", "WIN%"]) for _ in range(40)) for _ in range(8)]
    texts = [*good, *bad, good[0], good[0], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    posterior = dict(zip(texts, slow_model([quality_rules.measure(t)[-1] for t in texts]), strict=True))
    rows = [(slow_features(t), posterior[t]) for t in dict.fromkeys(texts)]
    weights, past = Counter(), Counter()
    for _ in range(150):
        grad = Counter()
        for found, p in rows:
            miss = (1 / (1 + math.exp(-sum(weights[k] * x for k, x in found) - weights["bias"])) - p) / len(rows)
            grad["bias"] += miss
            for k, x in found:
                grad[k] += miss * x
        for k in set(grad) | set(weights):
            g = grad[k] + 1e-5 * weights[k]
            past[k] += g * g
            weights[k] -= g / math.sqrt(1e-8 + past[k])
    want = {k: 1 / (1 + math.exp(-sum(weights[b] * x for b, x in slow_features(t)) - weights["bias"])) for k, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in quality_classifier.quality_classifier(docs).collect()}
    assert {k: r["score"] for k, r in got.items()} == pytest.approx(want, abs=1e-4)
    assert all(got[k]["kept"] == (bool(texts[k]) and want[k] >= 0.5) for k in want)


def test_copies_do_not_crowd_the_sample(spark, prose, monkeypatch):
    """The driver gets the bounded number of rows, each text once, however many copies there are."""
    seen = []
    train = quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", lambda p, b, v: seen.append(len(p)) or train(p, b, v))
    docs = spark.createDataFrame([(None, prose[0])] * 3000 + list(enumerate(prose)), "doc_id long, text string")
    assert quality_classifier.quality_classifier(docs, max_training_docs=50).count() == docs.count()
    assert seen == [50]
