"""Every registered query against its SQL oracle on the small tables, whole results compared."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(x):
    """Values as comparable Python values; doubles to nine digits."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "is_finite"):
        return plain(float(x))
    return x


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, sf, tables, name):
    got = QUERIES[name](spark, sf)
    found = tables.execute(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in found.description)
    order = [next(i for i, d in enumerate(found.description) if d[0] == c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in order) for row in found.fetchall())
    have = Counter(tuple(plain(row[c]) for c in columns) for row in got.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
