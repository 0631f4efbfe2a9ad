"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessella.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return ""
        return str(v) if isinstance(v, (str, bool)) else repr(round(float(v), 6)) if hasattr(v, "__float__") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert not set(registry.SQL) - set(registry.QUERIES)


def test_columns_of_any_size_match_sql(spark, tmp_path):
    """Columns of four letters and more, none, and null."""
    keys = [None, 0, 1, 26, 27, 702, 703, 18278, 18279, 19999, 475254, 475255, 2000000000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    ours, theirs = registry.QUERIES["a1_columns"](spark, str(tmp_path)).toPandas(), con.execute(registry.SQL["a1_columns"]).df()
    assert len(ours) == len(keys)
    assert rows(ours) == rows(theirs)


def test_cached_answers_carry_no_texts(spark):
    """Pairs of questions are joined with digests of their texts."""
    plan = registry.QUERIES["semantic_lookup"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan
