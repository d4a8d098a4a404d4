import pytest
from conftest_llm import DOCS, ODD, rows_of


@pytest.fixture(scope="session")
def odd(spark):
    return rows_of(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
