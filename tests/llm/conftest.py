import duckdb
import pytest

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    return duckdb.connect()
