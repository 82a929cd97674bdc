"""Every query of the engine against its SQL, and its columns' types, over the smallest tables."""

import duckdb
import pytest

from quarry import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents pages".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}
#: The four arithmetic verbs differ in a word; the driver runs all.
NAMES = [n for n in sorted(queries.QUERIES) if n not in ("g21_add", "g22_subtract", "g23_multiply", "g24_divide")]


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    want = tables.sql(queries.SQL[name])
    kinds = {c: TYPES[str(t)] for c, t in zip(want.columns, want.types, strict=True)}
    got = queries.QUERIES[name](spark, SF)
    assert dict(got.dtypes) == kinds
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.SQL) and len(queries.QUERIES) > 70
