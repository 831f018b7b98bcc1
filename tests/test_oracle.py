"""Every query with SQL gives the rows that DuckDB gives at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

from sluicework.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = Counter(repr(plain(tuple(r[c] for c in cols))) for r in df.collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    theirs = Counter(repr(plain(r)) for r in con.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert ours == theirs
