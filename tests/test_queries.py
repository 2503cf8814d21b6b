"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from factloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    try:
        return round(float(value), 6) if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    columns = sorted(rows.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in rows.collect()), key=repr)
    assert got
    if name in ORACLE_SQL:
        with duckdb.connect() as db:
            for t in TABLES:
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
            found = db.execute(ORACLE_SQL[name])
            names = [d[0] for d in found.description]
            assert sorted(names) == columns
            want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        assert got == sorted(([plain(r[c]) for c in columns] for r in want), key=repr)
