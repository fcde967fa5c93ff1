import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    """Values of either engine in one form; floats to six digits."""
    import datetime
    import decimal

    if v is None or isinstance(v, (bool, str, bytes)):
        return repr(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    return f"{v:.6g}" if isinstance(v, int) and abs(v) < 10**5 else str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL over the smallest tables."""

    def check(build, sql):
        df = build(spark, SMALL)
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        ours = sorted(str([plain(x[c]) for c in order]) for x in df.collect())
        theirs = sorted(str([plain(x[names.index(c)]) for c in order]) for x in r.fetchall())
        assert ours == theirs
        return len(ours)

    return check
