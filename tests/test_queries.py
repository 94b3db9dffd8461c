"""Every query with SQL against DuckDB on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from wanderlake.plans import queries

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NA or v != v:
            return None
        return v if isinstance(v, str | bool) or str(type(v)).endswith("bool'>") else round(float(v), 5) + 0.0

    df = df[sorted(df.columns)]
    return sorted(str([str(value(v)) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {Path(p).stem} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.SQL[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stays_are_found_once_for_both_cutoffs(spark, monkeypatch):
    calls, find = [], queries.home_office.from_events
    monkeypatch.setattr(queries.home_office, "from_events", lambda *a: calls.append(a) or find(*a))
    queries.QUERIES["cutoff_discordance"](spark, SF)
    spark.catalog.clearCache()
    assert len(calls) == 1
