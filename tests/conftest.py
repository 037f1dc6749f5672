import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from cairn.session import ship_package

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.adaptive.enabled", "false")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


@pytest.fixture()
def as_in_production(spark):
    """The session with adaptive execution and whole-stage code, which the others do without to save time."""
    keys = ("spark.sql.adaptive.enabled", "spark.sql.codegen.wholeStage")
    for k in keys:
        spark.conf.set(k, "true")
    yield spark
    for k in keys:
        spark.conf.set(k, "false")


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    """Run SQL over the smallest tables with DuckDB: (columns, rows)."""
    import glob

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(SMALL + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    def run(sql):
        r = con.execute(sql)
        return [c[0] for c in r.description], r.fetchall()

    return run


def normalised(columns, rows):
    """Rows as sorted tuples in order of the column names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if x != x else round(x, 9) + 0.0
        if isinstance(x, (list, tuple)):
            return tuple(map(value, x))
        return x if isinstance(x, (int, str, type(None))) else str(x)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)
