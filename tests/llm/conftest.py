import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import ODD, SF, docs_of  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
