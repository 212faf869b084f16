"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tallyforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def form(v):
        if v is None or v != v:
            return None
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(form(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(tuple(r) for r in got.select(columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_constrained_clusters_hold_one_fact(spark):
    from tallyforge.operators.linking import constrained_clusters

    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.99), ("c", "d", 0.8), ("e", "f", 0.7)], "a string, b string, prob double")
    nodes = spark.createDataFrame([("a", "1"), ("b", None), ("c", "2"), ("d", "2"), ("e", None), ("f", None), ("g", "9")], "id string, fact string")
    got = {r["id"]: r["cluster"] for r in constrained_clusters(links, nodes, "id", ["fact"]).collect()}
    assert got == {"a": "a", "b": "b", "c": "b", "d": "b", "e": "e", "f": "e", "g": "g"}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
