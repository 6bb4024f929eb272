from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from maskwright.plans import ORACLES, QUERIES
from maskwright.plans.registry import INLINE, INLINE_ORACLES

SF = "/root/testdata/sf0.001"


def _rows(names, rows):
    return sorted(repr(tuple(dict(zip(names, r))[n] for n in sorted(names))) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES) + sorted(INLINE_ORACLES))
def test_matches_sql(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    expected = con.sql((ORACLES | INLINE_ORACLES)[name])
    got = (QUERIES | INLINE)[name](spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(expected.columns, expected.fetchall())
