"""Every query of the bar engine against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from tidebar.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "nation region customer supplier part orders lineitem events documents pages".split()

def comparable(df: pd.DataFrame) -> list[str]:
    for c in df.columns:
        x = df[c].dropna()
        if len(x) and isinstance(x.iloc[0], (datetime.date, pd.Timestamp)):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d %H:%M:%S")
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
    spark.catalog.clearCache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bootstrap_takes_the_replicates_of_the_reference(spark, monkeypatch):
    seen, real = [], catalog.validation.bootstrap
    monkeypatch.setattr(catalog.validation, "bootstrap", lambda rets, replicates=200: seen.append(replicates) or real(rets, 1))
    catalog.QUERIES["v5_bootstrap"](spark, SF)
    assert seen == [2000]
