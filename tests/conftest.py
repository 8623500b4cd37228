import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("TEST_SF_ROOT", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="session")
def scored(spark, small):
    from riskloom.sources import stand_ins
    from riskloom.staging import stage
    return stage(stand_ins.scored(spark, small), "test-scored")


@pytest.fixture(scope="session")
def piles(spark, scored):
    from riskloom.operators.splitting import stratified_split
    from riskloom.staging import stage
    return stage(stratified_split(scored), "test-piles")
