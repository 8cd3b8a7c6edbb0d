"""Relational sources over JDBC.

A table is read in parallel when a numeric/date ``partition_column`` and its
bounds are given (``numPartitions`` range queries, one per task); filters and
column pruning on the returned DataFrame are pushed into the remote SQL.
Credentials come from the caller's config dict, never from this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sqlserver_url(cfg: dict) -> str:
    """JDBC URL for SQL Server from a connection dict (host, port=1433, database,
    trusted_connection, timeout=30, encrypt)."""
    parts = [f"jdbc:sqlserver://{cfg['host']}:{int(cfg.get('port', 1433))}",
             f"databaseName={cfg['database']}", f"loginTimeout={int(cfg.get('timeout', 30))}"]
    if cfg.get("trusted_connection"):
        parts.append("integratedSecurity=true")
    if "encrypt" in cfg:
        enc = cfg["encrypt"]
        parts.append(f"encrypt={'true' if enc in (True, 'yes', 'true', 'mandatory') else 'false'}")
    if cfg.get("trust_server_certificate"):
        parts.append("trustServerCertificate=true")
    return ";".join(parts)


def postgres_url(cfg: dict) -> str:
    return f"jdbc:postgresql://{cfg['host']}:{int(cfg.get('port', 5432))}/{cfg['database']}"


def connection_url(cfg: dict) -> str:
    kind = cfg.get("type", "sqlserver")
    if "url" in cfg:
        return cfg["url"]
    if kind == "sqlserver":
        return sqlserver_url(cfg)
    if kind in ("postgres", "postgresql"):
        return postgres_url(cfg)
    raise ValueError(f"no JDBC URL rule for connection type {kind!r}")


def _properties(cfg: dict) -> dict:
    props = {}
    for k in ("user", "password", "driver"):
        if cfg.get(k):
            props[k] = str(cfg[k])
    if cfg.get("fetchsize"):
        props["fetchsize"] = str(cfg["fetchsize"])
    return props


def jdbc_options(cfg: dict, table: str | None = None, query: str | None = None,
                 partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None) -> dict[str, str]:
    """All reader options for one table (``dbtable``) or one remote query (``query``)."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    opts = {"url": connection_url(cfg), **_properties(cfg)}
    if table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query
    if partition_column:
        if query is not None:
            raise ValueError("partitioned reads need a table, not a query")
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned JDBC read needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(int(num_partitions)))
    return opts


def read_jdbc_table(spark: SparkSession, cfg: dict, table: str, partition_column: str | None = None,
                    lower_bound=None, upper_bound=None, num_partitions: int | None = None) -> DataFrame:
    """Read one table; parallel range reads (one per task) when a partition column is given."""
    opts = jdbc_options(cfg, table=table, partition_column=partition_column, lower_bound=lower_bound,
                        upper_bound=upper_bound, num_partitions=num_partitions)
    return spark.read.format("jdbc").options(**opts).load()


def read_jdbc_query(spark: SparkSession, cfg: dict, query: str) -> DataFrame:
    """S5 against a remote database: the query runs there, its rows stream in."""
    return spark.read.format("jdbc").options(**jdbc_options(cfg, query=query)).load()


def read_jdbc_partitioned(spark: SparkSession, cfg: dict, table: str, partition_column: str,
                          num_partitions: int) -> DataFrame:
    """Parallel read without known bounds: one pushed-down ``min/max`` query on
    the remote side fixes them, then ``num_partitions`` range reads follow."""
    bounds = read_jdbc_query(spark, cfg, f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi "
                                         f"FROM {table}").first()
    if bounds is None or bounds["lo"] is None:
        return read_jdbc_table(spark, cfg, table)
    return read_jdbc_table(spark, cfg, table, partition_column, bounds["lo"], bounds["hi"], num_partitions)


def read_jdbc_tables(spark: SparkSession, cfg: dict, tables: dict[str, dict | None]) -> dict[str, DataFrame]:
    """Several tables at once: name -> partitioning options (or None)."""
    return {name: read_jdbc_table(spark, cfg, name, **(opts or {})) for name, opts in tables.items()}
