"""Equal messages are judged once."""

from pyspark.sql import functions as F

from sparkloom.operators import signals


def test_equal_keys_are_judged_once_and_nulls_stay(spark):
    texts = ["We always use tabs.", None, "We always use tabs.", "no", "Always use `make lint`"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "event_id long, text string").repartition(3)
    seen = []

    def judge(df):
        seen.append(df.count())
        return signals.entry_type(df)

    got = sorted(map(tuple, signals.once_each(rows, ["text"], judge).select("event_id", "type", "confidence").collect()))
    assert seen == [4] and len(got) == 100
    assert got == sorted(map(tuple, signals.entry_type(rows).select("event_id", "type", "confidence").collect()))
    pulled = lambda df: sorted(map(tuple, df.select("event_id", "trigger").collect()))
    assert pulled(signals.once_each(rows, ["text"], signals.triggers)) == pulled(signals.triggers(rows))


def test_queries_judge_fewer_texts_than_messages(spark, data, monkeypatch):
    import __spark_entry__

    seen = {}
    for name in ("entry_type", "triggers"):
        monkeypatch.setattr(signals, name, lambda df, f=getattr(signals, name), n=name: seen.setdefault(n, df.count()) and f(df))
    for query in ("entry_type_classify", "extraction_triggers"):
        __spark_entry__.queries()[query](spark, data)
    events = spark.read.parquet(f"{data}/events.parquet").agg(F.count(F.lit(1))).first()[0]
    assert 0 < max(seen.values()) <= 60 < events
