import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_documents import COLUMNS, odd_rows  # noqa: E402


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (10, 0, 0), (None, 1, 0), (3, None, None), (1, 0, 0)], "doc_id long, quality long, toxic long")
