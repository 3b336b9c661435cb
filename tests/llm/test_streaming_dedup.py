import hashlib
import re

from pyspark.sql import functions as F

from sparkloom.llm import streaming_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def slow(rows):
    """One row of each text stays, with the smallest doc_id; one without doc_id only where no other row has the text."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out, stays = [], set()
    for doc_id, text in rows:
        ids = [d for d in groups[norm(text)] if d is not None]
        keep = min(ids) if ids else None
        kept = doc_id == keep and norm(text) not in stays
        if kept:
            stays.add(norm(text))
        out.append((str(doc_id), str(keep), len(groups[norm(text)]), kept))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in df.collect())


def written(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(path)
    return path


ROWS = [(k, f"text  {k % 7}\n" if k % 2 else f"text {k % 7} ") for k in range(60)] + [(None, "text 1 "), (None, "only\tunnamed"), (70, None), (71, ""), (72, " "), (5, "text  5\n"), (73, "long " * 50_000)]


def test_against_brute_force_over_many_batches(spark, tmp_path):
    path = written(spark, tmp_path, ROWS, files=5)
    found = streaming_dedup.exact_dedup(spark, path, files_per_batch=1)
    assert got(found) == slow(ROWS)
    assert {r["digest"] for r in found.collect()} == {hashlib.sha256(norm(t).encode()).hexdigest() for _, t in ROWS}


def test_full_bytes_settle_colliding_digests(spark, tmp_path):
    path = written(spark, tmp_path, ROWS, files=3)
    weak = lambda c: F.sha2(F.substring(F.sha2(c, 256), 1, 1), 256)  # noqa: E731  sixteen digests only
    assert got(streaming_dedup.exact_dedup(spark, path, weak, files_per_batch=2)) == slow(ROWS)


def test_state_goes_on_from_its_checkpoint(spark, tmp_path):
    path = written(spark, tmp_path, [(1, "a"), (2, "b"), (3, "a")])
    home = str(tmp_path / "home")
    assert {(r["keep"]["doc_id"], r["group_size"]) for r in streaming_dedup.run_stream(spark, path, checkpoint=home).collect()} == {(1, 2), (2, 1)}
    spark.createDataFrame([(0, "a"), (4, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    assert {(r["keep"]["doc_id"], r["group_size"]) for r in streaming_dedup.run_stream(spark, path, checkpoint=home).collect()} == {(0, 3), (2, 1), (4, 1)}


def test_single_file_empty_table_and_extra_columns(spark, tmp_path, data):
    assert streaming_dedup.exact_dedup(spark, f"{data}/documents.parquet").count() == spark.read.parquet(f"{data}/documents.parquet").count()
    empty = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(empty)
    assert streaming_dedup.exact_dedup(spark, empty).count() == 0
    extra = str(tmp_path / "extra.parquet")
    spark.createDataFrame([(1, "a", 9, "x"), (2, "a", 9, "y")], "doc_id long, text string, digest long, keep string").write.parquet(extra)
    assert got(streaming_dedup.exact_dedup(spark, extra)) == slow([(1, "a"), (2, "a")])


def test_locator_names_the_kept_row(spark, tmp_path):
    path = written(spark, tmp_path, [(9, "x"), (3, "x"), (5, "y")])
    for r in streaming_dedup.exact_dedup(spark, path).collect():
        row = spark.read.parquet(r["keep_file"]).select("doc_id", F.col("_metadata.row_index").alias("n")).filter(F.col("n") == r["keep_row"]).first()
        assert row["doc_id"] == r["keep_id"]


def test_each_text_keeps_exactly_one_row(spark, tmp_path):
    rows = [(7, "twice"), (7, "twice"), (8, "twice"), (None, "no id"), (None, "no  id"), (None, "twice"), (9, "alone"), (None, "alone too")]
    found = streaming_dedup.exact_dedup(spark, written(spark, tmp_path, rows, files=4)).collect()
    kept = [r for r in found if r["kept"]]
    assert len(found) == 8 and sorted(str(r["doc_id"]) for r in kept) == ["7", "9", "None", "None"]
    assert len({r["digest"] for r in kept}) == 4


def test_salted_lookup_gives_the_same(spark, tmp_path, monkeypatch):
    path = written(spark, tmp_path, ROWS, files=3)
    attach = streaming_dedup.attach
    monkeypatch.setattr(streaming_dedup, "attach", lambda *a, **k: attach(*a, broadcast_rows=0, **k))
    assert got(streaming_dedup.exact_dedup(spark, path)) == slow(ROWS)


def test_the_stream_leaves_the_callers_settings(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in streaming_dedup.STATE_CONF}
    streaming_dedup.run_stream(spark, written(spark, tmp_path, ROWS[:5])).count()
    assert {k: spark.conf.get(k, None) for k in streaming_dedup.STATE_CONF} == before
