import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SHARED = tempfile.TemporaryDirectory(prefix="blockloom-tests-")
# The session is made on import: test modules build Column expressions when they are read.
SESSION = (
    SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
    .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", SHARED.name).config("spark.sql.warehouse.dir", f"{SHARED.name}/warehouse").getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
