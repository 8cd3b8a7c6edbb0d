import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from sieve.session import local_session  # noqa: E402
from sieve.staging import release_staged  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="sieve-tests")
    yield s
    release_staged(s)


CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()), T.StructField("age", T.LongType()),
    T.StructField("score", T.DoubleType()),
])
ORDERS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("customer_id", T.LongType()),
    T.StructField("amount", T.DoubleType()),
])


@pytest.fixture(scope="session")
def fixture_tables(spark):
    """The 6 + 3 row unit fixture, one planted defect per check."""
    customers = spark.createDataFrame([
        (1, "Alice", "alice@test.com", 30, 85.5),
        (2, "Bob", None, 25, 92.0),
        (3, "Charlie", "charlie@test.com", None, 78.0),
        (4, "Alice", "alice2@test.com", 30, 88.0),
        (5, "Eve", "eve@test.com", 150, 95.0),
        (6, "Frank", "frank@test.com", 35, 999.0),
    ], CUSTOMERS_SCHEMA)
    orders = spark.createDataFrame([(1, 1, 100.0), (2, 2, 200.0), (3, 999, 50.0)], ORDERS_SCHEMA)
    return {"customers": customers, "orders": orders}
