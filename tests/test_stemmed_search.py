"""Stemmed search by the postings of the wanted stems alone."""

import itertools

from sparkloom.functions.stem import head, stem
from sparkloom.operators import fulltext

TEXTS = ["Hating hated HATES hat", "onions, onion on", None, "tied ties tie tying ty", "ability abilities able", "", "none here", "possibly possibilities possible hating"]


def test_a_word_begins_as_its_stem_says():
    tails = ("", "s", "es", "ies", "y", "ed", "ing", "ational", "tional", "enci", "izer", "ably", "alli", "entli", "eli", "ousli", "ization", "ator", "iveness", "fulness", "aliti", "ivity", "ability",
             "ibilities", "icate", "ative", "iciti", "ement", "ion", "ying", "ingly", "bility", "e", "ll", "sses")
    for start, tail, last in itertools.product(("a", "by", "hop", "relat", "conflat", "tr", "possi", "cree", "y", "ann"), tails, ("", "s", "ed", "ing", "ness", "ly")):
        s = stem(start + tail + last)
        assert (start + tail + last).startswith(head(s)), (start + tail + last, s)


def test_equals_the_whole_index_and_keeps_no_other_words(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    stems = [stem(t) for t in ("hating", "onions", "tied", "possibilities")]
    kept = []
    monkeypatch.setattr(fulltext, "cut", lambda df, label="", f=fulltext.cut: kept.append(f(df, label)) or kept[-1])
    got = {r["doc_id"]: round(r["score"], 9) for r in fulltext.stemmed_bm25(docs, "text", stems).collect()}
    whole = fulltext.ranked(fulltext.stemmed_postings(docs, "text"), docs, stems)
    assert got == {r["doc_id"]: round(r["score"], 9) for r in whole.collect()} and {0, 1, 3, 7} <= got.keys()
    assert "none" not in {w for r in kept[0].collect() for w in r["w"] or ()}


def test_query_needs_no_postings_of_all_terms(spark, data, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(fulltext, "stemmed_postings", lambda *a: (_ for _ in ()).throw(AssertionError("builds postings of all terms")))
    assert 0 < __spark_entry__.queries()["fts_stemmed_topk"](spark, data).count() <= 25
