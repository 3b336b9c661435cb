"""Word borders lie between ASCII words, as in the queries' SQL."""

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import classify, fulltext

ROWS = [(1, "ÄBCDEFGH"), (2, "xABCDEFG"), (3, "éthe ñ123456ü"), (4, None), (5, "STOPPED!! ")]


def test_letters_beyond_ascii_end_words(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    flags = {r["doc_id"]: r["flags"] for r in classify.redflags(docs).collect()}
    assert flags == {1: 4, 2: 0, 3: 0, 4: 0, 5: 5}
    assert [(r["doc_id"], r["value"]) for r in classify.entities(docs).collect()] == [(3, "123456")]
    marked = {r["doc_id"]: r["m"] for r in docs.select("doc_id", fulltext.highlight(F.col("text"), ["the"]).alias("m")).collect()}
    assert marked[3] == "é<mark>the</mark> ñ123456ü" and marked[2] == "xABCDEFG"
    assert [r["doc_id"] for r in docs.filter(text.excluded(F.col("text"), ["the"], [])).collect()] == [3]
