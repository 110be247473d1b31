"""Registered queries run, and where SQL states their result, they equal it on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
FIREWALL = sorted(__import__("gatewright.plans.catalog", fromlist=["QUERIES"]).QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def _canonical(rows):
    def plain(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.5f}" if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", FIREWALL)
def test_query(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(columns).collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    a, b = _canonical(got), _canonical(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            if p != q:
                assert abs(float(p) - float(q)) < 2e-5


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_corpus_queries_are_there_with_their_package():
    names = __spark_entry__.queries()
    present = importlib.util.find_spec("gatewright.llm") is not None
    assert any(n.startswith("op4_") for n in names) == present
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_every_document_has_a_verdict_by_sink(spark):
    got = __spark_entry__.queries()["verdict_by_sink"](spark, SF).collect()
    assert sum(r.n for r in got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r.verdict for r in got if r.sink == "trusted_instruction"} == {"flagged", "clean-structural"}
    assert "blocked" in {r.verdict for r in got if r.sink != "trusted_instruction"}
