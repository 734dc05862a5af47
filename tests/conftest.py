import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *by):
    """Rows as sorted tuples."""
    got = [tuple(r) for r in (df.select(*by) if by else df).collect()]
    return sorted(got, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "list", str(x)) for x in r))


def plain(rows_, columns):
    """Rows as comparable text, columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if x is None or x != x:
            return "~"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows_)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not TESTDATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in TESTDATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same_as_sql(spark, duck, query, sql):
    """The query over the small tables has the rows of its SQL."""
    df = query(spark, str(TESTDATA))
    con = duck.execute(sql)
    names = [c[0] for c in con.description]
    want = con.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want, names)
