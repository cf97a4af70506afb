"""One Spark session for all tests, and the comparison of a query with its SQL on the supplied tables."""

import datetime
import decimal
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("QUILLSPARK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master(os.environ.get("QUILLSPARK_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"file://{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(v):
    """A value as both engines would give it."""
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    found = [tuple(plain(r[k]) for k in at) for r in rows]
    return [columns[k] for k in at], sorted(found, key=repr)


def check_query(spark, run, sql, sf_dir):
    """Run a query and its SQL on the tables of ``sf_dir``; both must give the same rows."""
    df = run(spark, sf_dir)
    ours = ordered(df.columns, df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*' if f.is_dir() else ''}')")
    found = con.execute(sql)
    theirs = ordered([d[0] for d in found.description], found.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b]
    assert not wrong, f"{len(wrong)} rows differ, such as {wrong[0]}"
