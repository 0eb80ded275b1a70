"""Stored tables: typed writes, upserts, pages, change detection, search."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ROW, ParameterError, data_columns, nan_to_null, present, quoted
from rowloom.operators.ordering import dense, require_index
from rowloom.sources.schema import coerce_to_schema, infer_schema, schema_signature

PAGE_LIMIT = 1_000


def write_typed(df: DataFrame, schema: list[dict[str, Any]], path: str) -> DataFrame:
    """Replace the table at ``path`` by ``df`` coerced to ``schema``."""
    coerce_to_schema(df, schema).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert_by_row_index(target: DataFrame, source: DataFrame) -> DataFrame:
    """Merged table with an ``_action`` per position: kept, upserted, deleted.

    Rows of ``source`` that differ replace those of ``target``; positions that
    ``source`` lacks are marked deleted. Both sides are compared on the stored
    types of the target, NULL equal to NULL. Write :func:`live_rows` of the
    result to a new path.
    """
    require_index(target, "upsert")
    require_index(source, "upsert")
    names = data_columns(target)
    if set(names) != set(data_columns(source)):
        raise ParameterError("columns differ: rebuild the table instead")
    old = nan_to_null(target)
    t = old.select(quoted(ROW).alias("__t"), *[quoted(c).alias(f"__o{i}") for i, c in enumerate(names)])
    s = source.select(
        quoted(ROW).alias("__s"),
        *[present(source, c).try_cast(old.schema[c].dataType).alias(f"__n{i}") for i, c in enumerate(names)],
    )
    joined = t.join(s, F.col("__t") == F.col("__s"), "full")
    same = reduce(lambda a, b: a & b, [F.col(f"__o{i}").eqNullSafe(F.col(f"__n{i}")) for i in range(len(names))])
    action = (
        F.when(F.col("__s").isNull(), "deleted")
        .when(F.col("__t").isNull() | ~same, "upserted")
        .otherwise("kept")
    )
    values = [
        F.when(F.col("__s").isNotNull(), F.col(f"__n{i}")).otherwise(F.col(f"__o{i}")).alias(c) for i, c in enumerate(names)
    ]
    return joined.select(F.coalesce("__s", "__t").alias(ROW), *values, action.alias("_action"))


def live_rows(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("_action") != "deleted").drop("_action")


def upsert_counts(merged: DataFrame) -> DataFrame:
    def count(action: str):
        return F.count(F.when(F.col("_action") == action, 1))

    return merged.agg(
        count("upserted").alias("upserted_rows"),
        count("deleted").alias("deleted_rows"),
        F.count(F.when(F.col("_action") != "deleted", 1)).alias("total_rows"),
    )


def save(df: DataFrame, path: str, version: int = 1, previous: DataFrame | None = None) -> dict[str, Any]:
    """Store a prepared table under a versioned path.

    Without ``previous``, or when the schema changed, the table is rebuilt;
    otherwise changed rows are merged into a new snapshot.
    """
    require_index(df, "save")
    schema = infer_schema(df, samples=False)
    typed = coerce_to_schema(df, schema)
    rebuilt = previous is None or schema_signature(previous) != schema_signature(typed)
    place = f"{path.rstrip('/')}/v{version}"
    if rebuilt:
        typed.write.mode("overwrite").parquet(place)
        rows = df.sparkSession.read.parquet(place).count()
        counts = {"upserted_rows": rows, "deleted_rows": 0, "total_rows": rows}
    else:
        merged = upsert_by_row_index(previous, typed)
        merged.write.mode("overwrite").parquet(f"{place}_merge")
        stored = df.sparkSession.read.parquet(f"{place}_merge")
        counts = upsert_counts(stored).first().asDict()
        live_rows(stored).write.mode("overwrite").parquet(place)
    return {"rebuilt": rebuilt, "path": place, "schema": schema, **counts}


def read_page(df: DataFrame, limit: int = 200, offset: int = 0, cap: int = PAGE_LIMIT) -> DataFrame:
    """A page by position: a range filter, which reaches the scan unless rows are missing in between."""
    df, _ = dense(df, "read_page")
    size, start = max(1, min(cap, int(limit))), max(0, int(offset))
    return df.filter((F.col(ROW) >= start) & (F.col(ROW) < start + size))


def detect_changed_documents(old: DataFrame, new: DataFrame, key: str = "filename", content: str = "content") -> DataFrame:
    """``new``, ``unchanged`` or ``changed`` per document, by SHA-256.

    ``old`` may hold hashes (``file_hash``) or contents; only 64-character
    digests travel in the join.
    """
    held = F.col("file_hash") if "file_hash" in old.columns else F.sha2(quoted(content).cast("binary"), 256)
    before = old.select(quoted(key).alias("__k"), held.alias("__old"))
    after = new.select(quoted(key), F.sha2(quoted(content).cast("binary"), 256).alias("file_hash"))
    joined = after.join(before, quoted(key) == F.col("__k"), "left")
    status = (
        F.when(F.col("__k").isNull(), "new").when(F.col("__old") == F.col("file_hash"), "unchanged").otherwise("changed")
    )
    return joined.select(quoted(key), "file_hash", status.alias("status"))


def search_catalog(catalog: DataFrame, query: str, folder: str = "all") -> DataFrame:
    """Datasets whose name, folder or column names contain the text.

    ``catalog`` has ``name``, ``folder`` and an array ``columns``.
    """
    found = catalog if folder == "all" else catalog.filter(F.coalesce("folder", F.lit("default")) == folder)
    needle = str(query or "").strip().lower()
    if not needle:
        return found

    def has(c):
        return F.lower(c).contains(needle)

    return found.filter(
        F.coalesce(has(F.col("name")), F.lit(False))
        | has(F.coalesce("folder", F.lit("default")))
        | F.coalesce(has(F.array_join("columns", " ")), F.lit(False))
    )
