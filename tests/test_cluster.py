"""Queries whose driver and executors must be JVMs of their own, as no local session has them."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ("src_foreign_table", "src_jdbc", "join_lateral")

RUN = """
import importlib.util, json, sys

root, folder, *names = sys.argv[1:]
sys.path.insert(0, root)
spec = importlib.util.spec_from_file_location("compare", f"{root}/tools/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)
from pyspark.sql import SparkSession

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"file://{folder}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
said, sf = {}, "/root/testdata/sf0.01"
for name in names:
    try:
        said[name] = compare.compare(spark, compare.oracle(sf), sf, name)
    except Exception as e:
        said[name] = f"{type(e).__name__}: {str(e)[:600]}"
with open(f"{folder}/said.json", "w") as f:
    json.dump(said, f)
spark.stop()
"""


@pytest.fixture(scope="module")
def said(tmp_path_factory):
    import json

    folder = tmp_path_factory.mktemp("cluster")
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", RUN, ROOT, str(folder), *NAMES], env=env, cwd=folder, capture_output=True, text=True, timeout=300)
    assert (folder / "said.json").exists(), done.stderr[-2000:]
    return json.loads((folder / "said.json").read_text())


@pytest.mark.parametrize("name", NAMES)
def test_on_a_cluster(said, name):
    assert said[name] == ""
