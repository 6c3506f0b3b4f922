"""Every registered query of the library on sf0.001, against its SQL where it has one."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from weftline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if pd.isna(x):
        return "-"
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if x == int(x) else repr(round(float(x), 9))
    return str(x)


def rows(df, cols):
    return sorted(tuple(plain(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duckdb.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)
