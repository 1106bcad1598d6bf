"""Stages of the pipeline let executors give back the memory of the stage before."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import corpus_pipeline
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 2)
spark = spark.config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{at}/shared").config("spark.executor.extraJavaOptions", "-Xlog:gc:file={at}/gc-%p.log").getOrCreate()
docs = spark.createDataFrame([(1, "one two two"), (2, None)], "doc_id bigint, text string")
assert {{r["doc_id"]: r["n_tokens"] > 0 for r in corpus_pipeline.encode_tokens(spark, docs, "").collect()}} == {{1: True, 2: False}}
"""


def test_each_executor_collects_before_the_stage(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONDONTWRITEBYTECODE": "1"}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(at=tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]  # some are of executors that start at the end
    assert sum("Pause Full (System.gc())" in x for x in logs) == 2
