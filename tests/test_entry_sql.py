"""oracle_sql() is text: it needs neither a session nor the archives of the Spark installation."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

CODE = """
import builtins, io, pathlib, zipfile
import __spark_entry__ as e
from pyspark.sql import SparkSession

e.queries()


def no(*a, **k):
    raise AssertionError("a file was read")

builtins.open = io.open = pathlib.Path.open = pathlib.Path.glob = zipfile.ZipFile.__init__ = no
sql = e.oracle_sql()
assert len(sql) > 140 and all(isinstance(v, str) for v in sql.values())
assert SparkSession.getActiveSession() is None
"""


def test_sql_is_built_without_session_or_files():
    subprocess.run([sys.executable, "-c", CODE], check=True, cwd=str(Path(entry.__file__).parent))


AWAY = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.queries()["porter_stem"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_workers_get_the_package(tmp_path):
    """The session is a plain one, started elsewhere, whose workers don't know the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", AWAY, str(Path(entry.__file__).parent)], check=True, cwd=str(tmp_path), env=env)
