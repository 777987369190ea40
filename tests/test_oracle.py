"""Every query that has an oracle gives the oracle's rows, and every other one runs."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from motorlake.plans import catalogue, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    if isinstance(value, list):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_oracle(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA)
    theirs = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0
