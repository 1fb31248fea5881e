"""Every query with SQL gives DuckDB's rows; the others run."""

import duckdb
import pandas as pd
import pytest

from tamarack.plans.registry import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    text = df.map(lambda v: "null" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        pd.testing.assert_frame_equal(normal(got.toPandas()), normal(con.sql(ORACLE_SQL[name]).df()))
    else:
        assert got.count() > 0
