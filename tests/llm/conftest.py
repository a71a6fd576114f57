import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import SCHEMA  # noqa: E402


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, schema=SCHEMA):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
