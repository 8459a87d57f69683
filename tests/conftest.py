import os

import pytest
from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
os.environ.setdefault("PYTHONPATH", os.pathsep.join((os.path.dirname(_HERE), _HERE)))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
