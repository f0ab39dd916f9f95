"""Every registered query of the package against its DuckDB SQL, on the smallest tables."""

import math

import duckdb
import pytest
from caseload.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return float(v) if type(v).__name__ == "Decimal" else v


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-6 * max(1, abs(a))
    return a == b


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    key = lambda r: [(x is None, str(round(x, 5) + 0.0) if isinstance(x, (int, float)) else str(x)) for x in r]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=key)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = rows(columns, duck.fetchall()), rows(df.columns, df.collect())
    assert len(want) == len(got)
    for w, g in zip(want, got, strict=True):
        assert all(same(x, y) for x, y in zip(w, g, strict=True)), (w, g)
