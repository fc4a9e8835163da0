import pytest
from pyspark.sql import SparkSession

from hookloom.operators.catalog import compile_lookup
from hookloom.session import configure
from hookloom.sources.catalog import load_spec_catalog


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    return load_spec_catalog(spark).cache()


@pytest.fixture(scope="session")
def lookup(catalog):
    return compile_lookup(catalog)
