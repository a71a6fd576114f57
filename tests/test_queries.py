"""Every registered query against its SQL on the smallest data set."""

import __spark_entry__ as e
import pytest
from compare import compare

from veriform.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, SF, e.queries()[name], e.oracle_sql()[name]) is None


def test_entry_has_a_row_per_invoice(spark):
    df = e.entry(spark)
    assert df.columns == ["InvoiceID", "line", "status", "retries"]
    assert df.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
