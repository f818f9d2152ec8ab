from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tests_llm_odd import ODD, ODD_SCHEMA


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(*r, *["x"] * 9) for r in ODD], ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def table(spark):
    """A driver table at scale factor 0.01 or another."""

    def read(name: str, sf: str = "0.01"):
        path = f"/root/testdata/sf{sf}/{name}.parquet"
        if not Path(path).exists():
            pytest.skip("no driver tables here")
        return spark.read.parquet(path)

    return read


@pytest.fixture
def same_as_sql():
    """Rows of a query and of its SQL, both sorted, by column name."""

    def check(df, sql: str, sf: str = "0.01") -> None:
        with duckdb.connect() as c:
            for p in Path(f"/root/testdata/sf{sf}").glob("*.parquet"):
                c.execute(f"create view {p.stem} as select * from '{p}'")
            names = sorted(df.columns)
            cursor = c.execute(f"select {', '.join(names)} from ({sql})")
            wanted = cursor.fetchall()
        got = [tuple(r) for r in df.select(*names).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, wanted))

    return check
