"""A database in the driver's process, in a session whose executors are other processes."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark
import pytest

import __spark_entry__ as entry
from quern.sources.embedded import embedded

RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from quern.sources import embedded
at, sf = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "900m").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{at}/shared").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for f in (embedded.read, embedded.append):
    f.__defaults__ = (40,)  # several parts
print(json.dumps({q: [list(r) for r in entry.queries()[q](spark, sf).collect()] for q in ("jdbc_query_scan", "jdbc_ranged_load")}))
spark.stop()
"""


@pytest.fixture(scope="module")
def rows(sf, tmp_path_factory):
    at, repo = tmp_path_factory.mktemp("cluster"), Path(__file__).resolve().parent.parent
    (at / "home/work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors run in Spark's home
        if p.name != "work":
            (at / "home" / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"SPARK_HOME": str(at / "home"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(repo)}
    done = subprocess.run([sys.executable, "-c", RUN, str(at), sf], cwd=at, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.splitlines()[-1])


@pytest.mark.parametrize("name", ["jdbc_query_scan", "jdbc_ranged_load"])
def test_executors_of_other_processes(rows, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet'")
    assert sorted(map(tuple, rows[name])) == sorted(con.sql(entry.oracle_sql()[name]).fetchall())


def test_which_databases_are_embedded():
    assert all(map(embedded, ("jdbc:derby:memory:t;create=true", "jdbc:derby:/tmp/db", "jdbc:h2:mem:t", "jdbc:hsqldb:file:t", "jdbc:sqlite:t.db")))
    assert not any(map(embedded, ("jdbc:derby://host:1527/db", "jdbc:h2:tcp://host/t", "jdbc:hsqldb:hsql://host/t", "jdbc:postgresql://host/t", "jdbc:oracle:thin:@host:1521:x")))
