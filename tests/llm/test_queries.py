import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.llm.queries import ORACLES, QUERIES

TABLES = "documents pages conversations labels benchmark embeddings".split()


def rows(cursor_rows):
    return sorted(map(repr, cursor_rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(tuple(r) for r in df.select(*names).collect()) == rows(found.fetchall())


def test_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == spark.read.parquet(f"{data}/documents.parquet").columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
        if name == "line dedup":
            assert sizes[-1] == sizes[-2]
        elif name != "mixing sources":
            assert 0 < sizes[-1] < sizes[-2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.filter("start = 0").count() == sizes[-1]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and os.path.exists(corpus_pipeline.__file__)


def test_native_operators_run_no_python(spark, data):
    for name in (n for n in QUERIES if n.startswith(("op1_", "op5_", "op11_"))):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
