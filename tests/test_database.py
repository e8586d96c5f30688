"""The SQL source and sink on a database that several processes open."""

from __future__ import annotations

import os
import sqlite3
import subprocess
import sys

import pytest

from rillmark.plans import sinks
from rillmark.sources import database, scan
from tests.conftest import ROOT

KINDS = "k long, i int, d double, s string, y binary, b boolean"


def test_rows_come_back_as_they_went(spark, tmp_path):
    url = f"sqlite:///{tmp_path}/d.db"
    given = [(1, 2, 0.5, "a\0é", b"\x00\xff", True), (2**63 - 1, None, None, None, None, None), (None, -1, float("inf"), "", b"", False)]
    sinks.write_jdbc(spark.createDataFrame(given, KINDS).repartition(3), url, 'odd "T"', mode="overwrite")
    found = scan.scan_jdbc(spark, url, table='"odd ""T"""')
    assert dict(found.dtypes) == dict(spark.createDataFrame([], KINDS).dtypes)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(k, i, d, s, y, b) for k, i, d, s, y, b in given], key=str)
    for n in (0, 1, 2, 7):  # bounds deal the rows, they do not filter; a NULL is in one part
        dealt = scan.scan_jdbc(spark, url, table='"odd ""T"""', partitioning={"column": "i", "lower": 0, "upper": 2, "n": n})
        assert dealt.count() == 3


def test_modes_and_what_the_database_cannot_hold(spark, tmp_path):
    url = f"sqlite:///{tmp_path}/d.db"
    df = spark.createDataFrame([(1,), (2,)], "k long")
    sinks.write_jdbc(df, url, "T")
    sinks.write_jdbc(df, url, "T")
    sinks.write_jdbc(df, url, "T", mode="ignore")
    count = lambda: scan.scan_jdbc(spark, url, query="SELECT count(*) AS n FROM T", customSchema="n bigint").first()["n"]
    assert count() == 4
    with pytest.raises(ValueError, match="exists"):
        sinks.write_jdbc(df, url, "T", mode="error")
    sinks.write_jdbc(df, url, "T", mode="overwrite")
    assert count() == 2
    with pytest.raises(ValueError, match="customSchema"):
        scan.scan_jdbc(spark, url, query="SELECT count(*) AS n FROM T")
    with pytest.raises(ValueError, match="cast"):
        sinks.write_jdbc(df.selectExpr("current_date() AS d"), url, "D")
    with pytest.raises(Exception, match="NaN"):
        sinks.write_jdbc(df.selectExpr("double('NaN') AS d"), url, "N")
    with pytest.raises(ValueError, match="absolute"):
        sinks.write_jdbc(df, "sqlite:///:memory:", "T")


def test_a_repeated_task_leaves_its_rows_once(spark, tmp_path):
    url = f"sqlite:///{tmp_path}/d.db"
    df = spark.range(100).repartition(3)
    sinks.write_jdbc(df, url, "T")
    with sqlite3.connect(f"{tmp_path}/d.db") as db:
        job = db.execute(f"SELECT DISTINCT job FROM {database.MARKS}").fetchall()
        assert len(job) == 1
    df.write.format("rillmark_sqlite").options(url=url, table="T", batchsize=10, job=job[0][0]).mode("append").save()
    assert scan.scan_jdbc(spark, url, table="T").count() == 100


def test_parts_of_a_query_are_found_by_row_numbers(spark, tmp_path):
    url = f"sqlite:///{tmp_path}/d.db"
    sinks.write_jdbc(spark.range(10), url, "T")
    with sqlite3.connect(f"{tmp_path}/d.db") as db:
        plan = db.execute('EXPLAIN QUERY PLAN SELECT * FROM (SELECT * FROM (SELECT id, rowid AS R FROM T WHERE id > 1)) WHERE "R" >= 3 AND "R" < 5').fetchall()
    assert len(plan) == 1 and "SEARCH" in plan[0][-1]


def test_driver_and_executors_share_the_database(tmp_path):
    """Before, the table was made in the driver's memory and the rows went to an executor's."""
    code = f"""
import sys
from pyspark.sql import SparkSession
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.driver.host": "127.0.0.1"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from rillmark import queries
rows = queries.QUERIES["jdbc_round_trip"](spark, "/root/testdata/sf0.001")
want = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_totalprice > 1000").select("o_orderkey", "o_totalprice")
assert want.count() and not rows.exceptAll(want).count() and not want.exceptAll(rows).count()
print("equal")
"""
    import pyspark

    home = tmp_path / "home"
    home.mkdir()
    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(f"{os.path.dirname(pyspark.__file__)}/{name}")
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}
    for key in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(key, None)
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert done.stdout.endswith("equal\n"), done.stderr[-3000:]
