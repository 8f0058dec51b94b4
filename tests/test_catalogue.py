"""Every query against its SQL in DuckDB, and what Catalyst makes of two of them."""

import math

import duckdb
import pytest

from strata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


def test_plans(spark, sf_dir):
    text = catalogue.memory_evict(spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in text
    assert "WindowGroupLimit" in catalogue.vector_topk(spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in catalogue.sql_native_join(spark, sf_dir)._jdf.queryExecution().toString()


def test_kmeans_operator_is_covered(spark, sf_dir, monkeypatch):
    from strata.operators import cluster

    asked, real = [], cluster.assign
    monkeypatch.setattr(cluster, "assign", lambda *a, **b: asked.append(1) or real(*a, **b))
    n = catalogue.read(spark, sf_dir, "embeddings").count()
    assert catalogue.queries()["kmeans_assign"](spark, sf_dir).count() == n and asked
    got = catalogue.queries()["kmeans_run"](spark, sf_dir).collect()
    assert len({r["vec_id"] for r in got}) == len(got) == n and {r["cluster"] for r in got} <= set(range(5))
    assert "kmeans_init" in catalogue.queries()


def test_entry_has_sql_for_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
