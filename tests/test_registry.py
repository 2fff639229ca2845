"""Every registered query of the library runs on the smallest tables and equals its SQL."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from tidymer.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{SF}/labels.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name not in registry.ORACLES:
        return
    answer = duck.sql(registry.ORACLES[name])
    assert sorted(frame.columns) == sorted(answer.columns)
    ours, theirs = canonical(rows, frame.columns), canonical(answer.fetchall(), answer.columns)
    assert len(ours) == len(theirs)
    assert all(a == pytest.approx(b) if all(isinstance(v, float) for v in (*a, *b)) else a == b for a, b in zip(ours, theirs, strict=True))
