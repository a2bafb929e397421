"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):  # exact: the driver's value hash may compare bits
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_ORACLE)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = [tuple(r[dcols.index(c)] for c in sorted(dcols)) for r in cur.fetchall()]
    assert cols == sorted(dcols)
    type_map = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        assert type_map.get(st, st) == duck_types[f.name], (f.name, st, duck_types[f.name])
    assert len(srows) == len(drows)
    assert _key(srows) == _key(drows)


def test_every_query_has_an_oracle():
    from probitas.plans.registry import ORACLE_SQL, QUERIES, load_all
    load_all()
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "fact_pvalue" in df.columns
