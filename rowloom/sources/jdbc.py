"""Tables and queries of databases reached by JDBC."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError

FETCH_ROWS = 1_000

# A table name that needs no quoting, and words of a query that change data.
TABLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")
READ_STARTS = ("select", "with", "explain")
WRITE_WORDS = (
    "insert", "update", "delete", "drop", "truncate", "alter", "create", "grant", "revoke", "comment", "merge", "call",
    "copy",
)


def check_table_name(name: str) -> str:
    token = str(name or "").strip()
    if not TABLE_NAME.fullmatch(token):
        raise ParameterError(f"not a table name: {name!r}")
    return token


def check_read_only(sql: str) -> str:
    """Refuse any statement that does not only read."""
    token = str(sql or "").strip().rstrip(";").strip()
    words = re.findall(r"[a-z_]+", token.lower())
    if not words or words[0] not in READ_STARTS:
        raise ParameterError("only SELECT, WITH and EXPLAIN are allowed")
    if ";" in token or set(words) & set(WRITE_WORDS):
        raise ParameterError("the query would change data")
    return token


def _reader(spark: SparkSession, url: str, properties: dict[str, str] | None):
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", FETCH_ROWS)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    return reader


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    max_rows: int | None = None,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table, read in parallel ranges when a partition column is named.

    All of it, unless the caller gives ``max_rows``.
    """
    reader = _reader(spark, url, properties).option("dbtable", check_table_name(table))
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", check_table_name(partition_column))
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", partitions)
        )
    df = reader.load()
    return df if max_rows is None else df.limit(int(max_rows))


def read_jdbc_query(
    spark: SparkSession,
    url: str,
    sql: str,
    max_rows: int | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A read-only query; empty results fail, and results beyond ``max_rows`` if it is given."""
    df = _reader(spark, url, properties).option("query", check_read_only(sql)).load()
    seen = df.limit(1 if max_rows is None else int(max_rows) + 1).count()
    if not seen:
        raise ParameterError("the query returned no rows")
    if max_rows is not None and seen > int(max_rows):
        raise ParameterError(f"the query returned more than {max_rows} rows")
    return df


# Where each database lists its tables and columns.
LISTINGS = {
    "postgresql": ("information_schema.tables", "information_schema.columns"),
    "mysql": ("information_schema.tables", "information_schema.columns"),
    "sqlserver": ("INFORMATION_SCHEMA.TABLES", "INFORMATION_SCHEMA.COLUMNS"),
    "oracle": ("all_tables", "all_tab_columns"),
    "derby": ("SYS.SYSTABLES", "SYS.SYSCOLUMNS"),
}


def _dialect(url: str) -> str:
    name = re.match(r"jdbc:([a-z0-9]+)", url)
    kind = name.group(1) if name else ""
    if kind not in LISTINGS:
        raise ParameterError(f"no table listing known for {kind!r}")
    return kind


def list_tables(spark: SparkSession, url: str | None = None, schema: str | None = None, properties=None) -> DataFrame:
    """``table_schema, table_name`` of a database, or of Spark's own catalog."""
    if url is None:
        tables = spark.catalog.listTables(schema)
        rows = [(".".join(t.namespace or []), t.name) for t in tables]
        return spark.createDataFrame(rows, "table_schema string, table_name string")
    kind = _dialect(url)
    listing = _reader(spark, url, properties).option("dbtable", LISTINGS[kind][0]).load()
    if kind == "derby":
        schemas = _reader(spark, url, properties).option("dbtable", "SYS.SYSSCHEMAS").load()
        named = listing.join(schemas, "SCHEMAID").filter(F.col("TABLETYPE") == "T")
        out = named.select(F.col("SCHEMANAME").alias("table_schema"), F.col("TABLENAME").alias("table_name"))
    else:
        owner = "owner" if kind == "oracle" else "table_schema"
        out = listing.select(F.col(owner).alias("table_schema"), F.col("table_name"))
    return out.filter(F.col("table_schema") == schema) if schema else out


def table_schema(spark: SparkSession, table: str, url: str | None = None, properties=None) -> DataFrame:
    """``column_name, data_type, nullable`` as Spark reads the table."""
    name = check_table_name(table)
    df = spark.table(name) if url is None else _reader(spark, url, properties).option("dbtable", name).load()
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


SYNC_DDL = "source_table string, dataset string, status string, rows long, error string"


def sync_tables(
    spark: SparkSession,
    mappings: list[dict[str, Any]],
    read: Callable[[str], DataFrame],
    folder: str,
    threads: int = 4,
) -> DataFrame:
    """Copy every enabled mapping to ``folder/{dataset}``, one Spark job each.

    A mapping that fails is reported with its error and stops no other.
    """

    def run(m: dict[str, Any]):
        source, name = m.get("source_table", ""), m.get("dataset_name") or m.get("source_table", "")
        path = f"{folder.rstrip('/')}/{name}"
        try:
            df = read(check_table_name(source))
            existed = bool(m.get("dataset_id"))
            df.write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path).count()
            return source, name, "updated" if existed else "created", rows, None
        except Exception as err:  # noqa: BLE001 - isolated per table by design
            return source, name, "failed", None, str(err).split("\n")[0][:500]

    wanted = [m for m in mappings if m.get("enabled", True)]
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        results = list(pool.map(run, wanted))
    return spark.createDataFrame(results, SYNC_DDL)
