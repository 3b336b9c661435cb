"""A larger commit is more tasks, not larger ones."""

from sparkloom.operators import text_index


def test_a_crowded_term_is_dealt_by_words(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "cat " * 4) for k in range(60)], "doc_id long, content string")
    found = {}
    for words in (1_000_000, 3):
        monkeypatch.setattr(text_index, "TASK_WORDS", words, raising=False)
        index = text_index.commit(docs, text_index.create(spark, ("content",)))
        rows = text_index.postings(spark, index)
        assert rows.count() == 60 and index.words == 240 and index.docs == 60
        found[words] = len(rows.inputFiles())
    assert found[1_000_000] == 1 < found[3]
