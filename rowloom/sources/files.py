"""CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.guards import ROW, hashable, quoted
from rowloom.sources.schema import coerce_to_schema, infer_schema

# Cell texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str, typed: bool = True, multiline: bool = True) -> DataFrame:
    """CSV with a header row. Cells are read as text, missing tokens become
    NULL, and with ``typed`` the inferred schema is applied.

    Quoted line breaks (``multiline``) keep a file in one task; large inputs
    without them should turn it off so that files split.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multiline, escape='"', ignoreLeadingWhiteSpace=False
    )
    gaps = [F.when(~quoted(c).isin(*NA_TOKENS), quoted(c)).alias(c) for c in raw.columns]
    clean = raw.select(*gaps)
    return coerce_to_schema(clean, infer_schema(clean, samples=False)) if typed else clean


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or one record per line.

    The first non-blank character of the input tells which it is.
    """
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect()
    is_array = bool(first) and first[0]["value"].lstrip().startswith("[")
    return spark.read.json(path, multiLine=is_array)


def _flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, which is how a CSV cell holds them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else quoted(f.name) for f in df.schema.fields]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV part per partition with a header; the row index is left out."""
    _flat(df.drop(ROW)).write.mode(mode).csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.drop(ROW).write.mode(mode).option("ignoreNullFields", "false").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def table_hash(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and sum of row hashes."""
    named = df.select(*[quoted(c) for c in sorted(df.columns) if c != ROW])
    h = F.xxhash64(*hashable(named))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"))
