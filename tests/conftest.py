import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spanloom.session import local_session, ship

    s = local_session(8, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    """Rows as sorted tuples of strings, columns by name; numbers rounded alike on both sides."""
    import numbers

    import pandas as pd

    def one(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return f"{float(x):.6f}" if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(one, r)) for r in pdf[cols].astype(object).itertuples(index=False))
