"""Vectors of texts: the same sums as by rows of word pairs, but no pair becomes a row."""

from pyspark.sql import functions as F

from sparkloom.sources import views


def by_rows(docs, size=64):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    w = docs.filter("doc_id is not null").select("doc_id", "lang", words.alias("w")).filter("size(w) > 1")
    pairs = w.select("doc_id", "lang", F.posexplode("w").alias("k", "a"), "w").filter("k + 1 < size(w)").select("doc_id", "lang", F.xxhash64("a", F.expr("w[k + 1]")).alias("h"))
    out = {}
    for r in pairs.collect():
        out.setdefault((r["doc_id"], r["lang"]), [0.0] * size)[(r["h"] >> 1) % size] += 1.0 if r["h"] % 2 == 0 else -1.0
    return out


def test_vectors_of_texts(spark, data, tmp_path):
    """Given texts and odd ones; an id that comes twice in a language is one text, and in another language another."""
    given = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "one", None), (9004, "\ta\x0bb\x0c a\r\nb ", None), (9005, "a b c", "en"), (9005, "b c  d", "en"), (9005, "a b", "de"), (None, "a b", "en"),
           (9006, "a\u00a0b c\u2003d e", "fr"), (9007, "x " * 5000, "en")]
    docs = given.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = views.text_vectors(spark, str(tmp_path))
    want = by_rows(docs)
    rows = made.collect()
    assert {(r["vec_id"], r["lang"]): r["v"] for r in rows} == want and len(rows) == len(want) > 50
    assert dict(made.dtypes)["v"] == "array<double>"
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
