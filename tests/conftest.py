import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the workers


@pytest.fixture(scope="session")
def spark():
    place = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.master": "local[4]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.driver.memory": "4g",
        "spark.local.dir": place,
        "spark.sql.warehouse.dir": f"{place}/warehouse",
        "spark.checkpoint.dir": f"file://{place}/shared",
        "spark.sql.session.timeZone": "UTC",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
