"""Registered queries against their SQL at the smallest scale, where the tables are there."""

import os

import pytest

import __spark_entry__ as entry
from gritsieve.plans import queries as own

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Results of exemplar clustering that the SQL has as they are on the larger tables.
EXEMPLARS = {"check_typo_ap", "typo_suggestions", "typo_rows", "rare_words", "firstpass_default"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(values):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in values)


def views(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.fixture(scope="module")
def larger():
    return views(LARGER)


@here
@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_against_sql(spark, request, name):
    fixed = name in EXEMPLARS
    df = own.QUERIES[name](spark, LARGER if fixed else SF)
    rel = request.getfixturevalue("larger" if fixed else "duck").sql(own.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = [[r[c] for c in order] for r in df.collect()]
    want = [[r[rel.columns.index(c)] for c in order] for r in rel.fetchall()]
    assert rows(got) == rows(want)


@here
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
