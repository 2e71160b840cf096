"""The registered queries on the driver's smallest tables, and the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from gritsieve.llm import queries as llm
from gritsieve.llm import secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(llm.oracle_sql()[name])
    df = llm.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted(str([r[c] for c in order]) for r in df.collect())
    assert got == sorted(str([r[rel.columns.index(c)] for c in order]) for r in rel.fetchall())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name == "mix_to_weights":
            got = out.collect()
            assert {r.doc_id for r in got} == set(kept) and abs(sum(r.taken for r in got) - sum(r["size"] for r in got)) < 0.03 * sum(r["size"] for r in got)
            break
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(kept) and len(now) == docs.count()
        changed = {i for i in now if now[i] != kept[i]}
        assert not changed or name == "secret_scans" and all("[SECRET]" in now[i] for i in changed)
        kept = now
    assert secrets.find_spans(docs).filter("rule < 3").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
