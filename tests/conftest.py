import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from presslens.session import session

    s = session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def same_rows(df, con, sql):
    """Whether Spark's rows are DuckDB's, whatever the order; columns by name."""
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    theirs = sorted([tuple(normal(x[names.index(c)]) for c in cols) for x in r.fetchall()], key=repr)
    ours = sorted([tuple(normal(x[c]) for c in cols) for x in df.collect()], key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b
