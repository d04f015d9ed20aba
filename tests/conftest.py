import os
import sys
import tempfile

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    root = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", root).config("spark.sql.warehouse.dir", f"{root}/warehouse").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{root}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
