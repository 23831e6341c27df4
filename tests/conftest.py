import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same_rows(df, rel) -> None:
    """The two results as multisets; floats may differ by 1e-9 of their size, as sums in another order do, or by 1e-6."""
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [list(rel.columns).index(c) for c in names]
    number = lambda v: isinstance(v, float)
    # floats come last and with few digits in the order, so that a small difference doesn't change it
    key = lambda r: tuple((x is None, "" if number(x) else str(x)) for x in r) + tuple(f"{x:.5e}" for x in r if number(x))
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=key)
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    near = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1.1e-6) if number(x) and number(y) else x == y
    for a, b in zip(got, want, strict=True):
        assert all(map(near, a, b)), (a, b)


@pytest.fixture
def same():
    return same_rows
