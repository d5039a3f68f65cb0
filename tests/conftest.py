import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="relaylens-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("relaylens-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    from relaylens.session import ship_package

    ship_package(s)  # Python tasks import the package whatever the working directory
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="relaylens-test-")
