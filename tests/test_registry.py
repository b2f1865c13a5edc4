"""Every registered query runs on the smallest tables, and gives the rows of its SQL in another engine."""

import math
from pathlib import Path

import duckdb
import pytest

from quaylark.plans import catalog, coverage  # noqa: F401
from quaylark.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, names):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0 if math.isfinite(x) else x
        return str(x) if hasattr(x, "isoformat") else float(x) if hasattr(x, "as_tuple") else x

    return sorted(repr(tuple(value(r[n]) for n in names)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name in SQL:
        got = other.execute(SQL[name])
        names = [x[0] for x in got.description]
        want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
        assert sorted(names) == sorted(df.columns)
        assert plain(rows, sorted(names)) == plain(want, sorted(names))
    else:
        assert rows
