"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pytest
from lodestone.plans import registry
from lodestone.tables import NAMES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows(frame):
    """Columns by name, rows by what is no float, then by the floats."""
    names = sorted(frame.columns, key=lambda c: (frame[c].dtype.kind == "f", c))
    return names, frame[names].sort_values(names, key=lambda c: c if c.dtype.kind == "f" else c.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    names, got = rows(QUERIES[name](spark, sf_dir).toPandas())
    wanted, want = rows(duck.execute(SQL[name]).df())
    assert names == wanted and len(got) == len(want)
    for c in names:
        if got[c].dtype.kind == "f":  # sums of other orders may round the last of two places of large sums otherwise
            assert got[c].tolist() == pytest.approx(want[c].astype("Float64").to_numpy("float64", na_value=float("nan")).tolist(), abs=1e-6, rel=5e-5, nan_ok=True)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
