import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

#: Made at once, since columns in test modules need a session.
SESSION = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
    .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
