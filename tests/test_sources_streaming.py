"""Sources (CSV, JDBC on in-memory Derby) and stream = batch."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.functions import predicates as P
from sieve.operators import completeness as C
from sieve.operators import referential as R
from sieve.sources import files, jdbc
from sieve.sources.tables import read_table
from sieve.streaming import checks as S

from conftest import SF_SMALL


def test_csv_permissive_keeps_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="sieve-csv-")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("id,amount\n1,10.5\n2,abc\n3,\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DoubleType())])
    df = files.read_csv(spark, d, schema).cache()
    assert df.count() == 3
    assert [r["id"] for r in files.corrupt_rows(df).collect()] == [2]
    # NULL from a bad number and a genuine NULL both count as incomplete ...
    assert C.completeness(df, ["amount"]).summary.first()["violation_count"] == 2
    # ... and the corrupt-record column tells them apart
    assert files.corrupt_rows(df).filter(F.col("amount").isNull()).count() == 1


def test_jdbc_options():
    """No database may be started here, so the reader options are checked, not a live read."""
    cfg = {"type": "sqlserver", "host": "db", "database": "dq", "user": "u", "password": "p"}
    o = jdbc.jdbc_options(cfg, table="dbo.services", partition_column="service_id", lower_bound=1,
                          upper_bound=1_000_000, num_partitions=64)
    assert o["url"] == "jdbc:sqlserver://db:1433;databaseName=dq;loginTimeout=30"
    assert o["dbtable"] == "dbo.services" and o["numPartitions"] == "64" and o["user"] == "u"
    assert jdbc.jdbc_options(cfg, query="SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        jdbc.jdbc_options(cfg, table="t", partition_column="id")
    with pytest.raises(ValueError):
        jdbc.jdbc_options(cfg)


def test_jdbc_urls():
    u = jdbc.sqlserver_url({"host": "db", "database": "dq", "trusted_connection": True, "encrypt": "yes"})
    assert u.startswith("jdbc:sqlserver://db:1433;databaseName=dq") and "integratedSecurity=true" in u
    assert jdbc.postgres_url({"host": "h", "database": "d"}) == "jdbc:postgresql://h:5432/d"


def _events_stream(spark):
    schema = read_table(spark, SF_SMALL, "events").schema
    return S.file_stream(spark, SF_SMALL, schema, file_glob="events.parquet")


def test_stream_row_checks_equal_batch(spark):
    ev = read_table(spark, SF_SMALL, "events")
    stream = _events_stream(spark)
    preds = {"value_range": P.out_of_range(stream, "value", 1, 300),
             "known": P.pattern_violation("event_type", "^(view|click|purchase|signup)$")}
    q, good, bad = S.run_row_checks(spark, stream, preds)
    q.awaitTermination()
    batch_bad = ev.filter(P.out_of_range(ev, "value", 1, 300) |
                          P.pattern_violation("event_type", "^(view|click|purchase|signup)$")).count()
    assert spark.read.parquet(bad).count() == batch_bad
    assert spark.read.parquet(good).count() == ev.count() - batch_bad


def test_stream_orphans_equal_batch(spark):
    ev = read_table(spark, SF_SMALL, "events")
    cust = read_table(spark, SF_SMALL, "customer").filter(F.col("c_acctbal") > 0)
    q, path = S.run_to_parquet(spark, S.stream_orphans(_events_stream(spark), "user_id", cust, "c_custkey"), "t")
    q.awaitTermination()
    assert spark.read.parquet(path).count() == R.orphans(ev, "user_id", cust, "c_custkey").violations.count()


def test_windowed_trend_equals_batch(spark):
    ev = read_table(spark, SF_SMALL, "events")
    trend = S.windowed_trend(_events_stream(spark), "ts", {"errors": F.col("event_type") == "error"})
    q, path = S.run_to_parquet(spark, trend, "trend", output_mode="complete")
    q.awaitTermination()
    got = {r["d"]: (r["records_checked"], r["errors"]) for r in
           spark.read.parquet(path).select(F.to_date("window.start").alias("d"), "records_checked", "errors").collect()}
    want = {r["d"]: (r["n"], r["e"]) for r in ev.groupBy(F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e")).collect()}
    assert got == want


def test_drop_repeats_keeps_each_key_once(spark):
    ev = read_table(spark, SF_SMALL, "events")
    s = S.drop_repeats(_events_stream(spark), ["user_id", "event_type"], "ts", "1 hour")
    q, path = S.run_to_parquet(spark, s, "repeats")
    q.awaitTermination()
    out = spark.read.parquet(path)
    assert out.count() == ev.select("user_id", "event_type").distinct().count()


def test_batch_duplicates_per_micro_batch(spark):
    from sieve.operators.duplicates import duplicates
    ev = read_table(spark, SF_SMALL, "events")
    schema = ev.schema
    stream = S.file_stream(spark, SF_SMALL, schema, file_glob="events.parquet", max_files_per_trigger=1)
    q, path = S.run_batch_duplicates(spark, stream, ["user_id", "event_type"])
    q.awaitTermination()
    got = spark.read.parquet(path).collect()
    assert len(got) == 1 and got[0]["batch_id"] == 0
    assert got[0]["violation_count"] == duplicates(ev, ["user_id", "event_type"]).summary.first()["violation_count"]
