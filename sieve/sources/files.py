"""S3 (CSV) and S5 (query over registered tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             corrupt_column: str = CORRUPT, **options) -> DataFrame:
    """CSV with an explicit schema (never inferred), PERMISSIVE mode.

    A field that does not parse becomes NULL and the raw line is kept in
    ``corrupt_column`` so bad input can be counted apart from genuine NULLs.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(corrupt_column, T.StringType(), True)])
    reader = (spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", corrupt_column))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def corrupt_rows(df: DataFrame, corrupt_column: str = CORRUPT) -> DataFrame:
    """Rows of a PERMISSIVE read that did not parse."""
    return df.filter(F.col(corrupt_column).isNotNull())


def corrupt_summary(df: DataFrame, corrupt_column: str = CORRUPT) -> DataFrame:
    """One row: ``corrupt_rows`` (lines that did not parse), ``rows_with_nulls``
    (any data field NULL - parse failures and genuine NULLs alike) and
    ``total_rows``. One scan. (Spark also refuses a query over raw CSV that
    reads nothing but the corrupt-record column; this one reads the data.)"""
    data = [c for c in df.columns if c != corrupt_column]
    any_null = F.lit(False)
    for c in data:
        any_null = any_null | F.col(c).isNull()
    return df.agg(F.count_if(F.col(corrupt_column).isNotNull()).cast("bigint").alias("corrupt_rows"),
                  F.count_if(any_null).cast("bigint").alias("rows_with_nulls"),
                  F.count(F.lit(1)).cast("bigint").alias("total_rows"))


def without_corrupt_column(df: DataFrame, corrupt_column: str = CORRUPT) -> DataFrame:
    return df.drop(corrupt_column)


def read_query(spark: SparkSession, query: str) -> DataFrame:
    """``spark.sql`` over the session's temp views / catalog tables."""
    return spark.sql(query)
