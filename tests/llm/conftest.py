import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

from edges import CLASHING, ROWS  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
