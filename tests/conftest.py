import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from twinweave.plans.session import local_session, ship_package

    s = local_session("twinweave-tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SMALL).is_dir():
        pytest.skip("no test data here")
    return SMALL


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(pdf):
    """Rows as sorted texts, columns by name, numbers rounded."""

    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, bool):
            return x
        if isinstance(x, float):
            return int(x) if x == int(x) and abs(x) < 1e15 else round(x, 5)
        return x

    names = sorted(pdf.columns)
    return sorted(repr([cell(v) for v in r]) for r in pdf[names].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    def check(query, sql):
        got = query(spark, sf_dir).toPandas()
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check
