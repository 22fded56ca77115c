"""The shared folder with and without its setting; sessions of their own, with an empty configuration folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from quarrystone import session

ROOT = Path(__file__).resolve().parent.parent

LOCAL = """
from pyspark.sql import SparkSession
from quarrystone.session import checkpoint_dir, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
first = shared_dir(spark)
assert first.startswith("file:///") and shared_dir(spark) == first
spark.range(3).write.parquet(first + "/t")
assert spark.read.parquet(first + "/t").count() == 3
checkpoint_dir(spark)
assert spark.range(5).checkpoint().count() == 5
"""


def test_a_local_session_without_the_setting_gets_one_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", LOCAL], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]


class FakeConf(dict):
    def get(self, name, default=None):
        return dict.get(self, name, default)


class FakeSpark:
    def __init__(self, master, **settings):
        conf = self.conf = FakeConf(settings)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app", "getConf": lambda _: conf})()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="share"):
        session.shared_dir(FakeSpark("spark://host:7077"))
    assert session.shared_dir(FakeSpark("spark://host:7077", **{"spark.quarrystone.dir": "hdfs://n/x/"})) == "hdfs://n/x"
    assert session.shared_dir(FakeSpark("local[2]", **{"spark.checkpoint.dir": "file:///tmp/a"})) == "file:///tmp/a"
