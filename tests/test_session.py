"""Session helpers: tables kept between rounds, checked broadcasts, shipped code."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.session import cut, cut_counted, discard, scratch, shared_folder, ship, small


def test_cut_and_discard(spark):
    df = spark.range(5).select("id", F.lit(None).cast("string").alias("empty"))
    kept = cut(df)
    assert kept.dtypes == df.dtypes and kept.count() == 5
    folder = kept._cut_path.removeprefix("file://")
    assert os.path.isdir(folder)
    discard(kept)
    assert not os.path.exists(folder)


def test_small_is_checked(spark):
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small(spark.range(5), 5)) and "broadcast" not in plan(small(spark.range(6), 5))


def test_workers_get_the_code(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from palimpsest.functions.text import normalize_text
from palimpsest.sources import files
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
open({str(tmp_path / 'a.html')!r}, "w").write("<p>x</p>")
assert files.read_files(spark, {str(tmp_path)!r}, "html").select(normalize_text("text")).collect() == [("x",)]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)


def test_ship_once(spark):
    ship(spark)
    ship(spark)


def test_scratch_deletes_its_tables(spark):
    with scratch():
        kept, n = cut_counted(spark.range(7), "id > 2")
        folder = kept._cut_path.removeprefix("file://")
        assert n == 4 and kept.count() == 7 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_only_local_masters_go_without_a_shared_folder(spark):
    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf = Context(master, folder), {}

    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(Session(master))
        assert shared_folder(Session(master, "hdfs://host/shared")) == "hdfs://host/shared"
    assert shared_folder(Session("local[4]")).startswith("file:///tmp/spark-cut-")


def test_small_counts_bytes_too(spark):
    wide = spark.range(3).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small(wide, 5, 4000)) and "broadcast" not in plan(small(wide, 5, 2000))
