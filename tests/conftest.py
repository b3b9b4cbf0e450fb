import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    yield session
    session.stop()
