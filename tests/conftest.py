import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from kindred.ship import ship

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}{'/*.parquet' if t.is_dir() else ''}'")
    return con


def same_rows(df, con, sql):
    """Columns by name, rows in any order, floats to six digits."""
    import decimal
    import math

    def flat(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    cols = sorted(df.columns)
    got = sorted(repr([flat(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([flat(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want
