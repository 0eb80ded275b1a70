"""Schema inference, naming and coercion."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.guards import (
    ROW,
    ParameterError,
    data_columns,
    is_number,
    is_time_point,
    missing,
    number,
    parse_bool,
    parse_time,
    present,
    quoted,
    strip,
    text,
    text_is_json,
    text_to_bool,
    text_to_number,
    text_to_time,
    text_to_timestamp,
    timestamp,
    type_of,
)

SAMPLES = 5
SAMPLE_HEAD = 200
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
NAME_LIMIT = 55
RESERVED = ("_row_id", "_row_index")


def storage_name(name: str) -> str:
    safe = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", str(name).strip().lower())).strip("_") or "col"
    return (f"c_{safe}" if safe[0].isdigit() else safe)[:NAME_LIMIT]


def sanitize_names(names: list[str]) -> list[str]:
    """Safe lower-case names, made unique with ``_2``, ``_3`` and so on."""
    used: set[str] = set(RESERVED)
    out = []
    for i, raw in enumerate(names, 1):
        base = storage_name(str(raw).strip() or f"column_{i}")
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{base[:48]}_{n}"
        used.add(name)
        out.append(name)
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    names = data_columns(df)
    fresh = dict(zip(names, sanitize_names(names)))
    return df.select(*[quoted(c).alias(fresh.get(c, c)) for c in df.columns])


def names_an_id(name: str) -> bool:
    low = name.lower()
    return (
        low in {"id"}
        or low.endswith(("_id", "_key"))
        or low.startswith(("id_", "key_"))
        or any(word in low for word in ("uuid", "guid", "identifier"))
    )


def _share(test: Column) -> Column:
    return F.count(F.when(test, 1))


def _probes(df: DataFrame, name: str, token: Column) -> dict[str, Column]:
    """Counts from which the type of a text column is decided; ``token`` is
    the text without blanks around it."""
    base = {"missing": F.count(F.when(missing(df, name), 1))}
    if not isinstance(type_of(df, name), T.StringType):
        return base
    value = text_to_number(token)
    return base | {
        "bools": F.count(text_to_bool(token)),
        "numbers": F.count(value),
        "wholes": _share(value == F.floor(value)),
        "moments": F.count(text_to_timestamp(token, stripped=True)),
        "times": F.count(text_to_time(token, stripped=True)),
        "jsons": _share(text_is_json(token, stripped=True)),
        "uuids": _share(token.rlike(UUID_PATTERN)),
    }


def _decide(name: str, t: T.DataType, rows: int, seen: dict[str, int], unique: int) -> tuple[str, str]:
    held = rows - seen["missing"]
    if not held:
        return "string", "unknown"
    looks_like_id = names_an_id(name) and unique / held >= 0.97 and unique >= max(10, min(100, rows // 10 if rows else 10))
    if isinstance(t, T.BooleanType):
        return "bool", "boolean"
    if isinstance(t, T.IntegralType):
        return "int64", "id" if looks_like_id else "integer"
    if is_number(t):
        return "float64", "float"
    if is_time_point(t):
        return "datetime64[ns]", "datetime"
    if not isinstance(t, T.StringType):
        return "json", "json"
    share = {k: v / held for k, v in seen.items()}
    if share["bools"] >= 0.95:
        return "bool", "boolean"
    if share["numbers"] >= 0.95:
        if seen["wholes"] / seen["numbers"] >= 0.98:
            return "int64", "id" if looks_like_id else "integer"
        return "float64", "float"
    if share["moments"] >= 0.9 and share["times"] < 0.8:
        return "datetime64[ns]", "datetime"
    if share["times"] >= 0.9 and any(w in name.lower() for w in ("time", "hour", "minute", "clock")):
        return "time", "time"
    if share["jsons"] >= 0.9:
        return "json", "json"
    if looks_like_id or share["uuids"] >= 0.9:
        return "string", "id"
    if unique <= max(50, rows // 20):
        return "object", "categorical"
    return "string", "text"


def distinct_key(df: DataFrame, name: str) -> Column:
    """Value to count distinct by; maps are compared as sorted entries."""
    c = present(df, name)
    return F.to_json(F.array_sort(F.map_entries(c))) if isinstance(type_of(df, name), T.MapType) else c


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, int]:
    """Distinct non-missing values per column. Exact counts shuffle every
    distinct value once; ``exact=False`` keeps one sketch per column instead."""
    count = F.count_distinct if exact else F.approx_count_distinct
    if not columns:
        return {}
    row = df.agg(*[count(distinct_key(df, c)).alias(f"u{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def infer_schema(df: DataFrame, exact: bool = True, samples: bool = True) -> list[dict[str, Any]]:
    """Per column: type, meaning, missing and distinct counts, first samples.

    One aggregate holds all probes, a second the distinct counts; the verdict
    is drawn from those two rows.
    """
    names = data_columns(df)
    texts = [c for c in names if isinstance(type_of(df, c), T.StringType)]
    tokens = {c: f"__token{i}" for i, c in enumerate(texts)}
    stripped = df.withColumns({t: strip(quoted(c)) for c, t in tokens.items()}) if texts else df
    probes = {c: _probes(df, c, F.col(tokens[c]) if c in tokens else quoted(c)) for c in names}
    flat = [p.alias(f"{k}_{i}") for i, c in enumerate(names) for k, p in probes[c].items()]
    row = stripped.agg(F.count(F.lit(1)).alias("rows"), *flat).first().asDict()
    unique = distinct_counts(df, names, exact)
    firsts = _first_values(df, names) if samples else {c: [] for c in names}
    out = []
    for i, c in enumerate(names):
        seen = {k: row[f"{k}_{i}"] for k in probes[c]}
        dtype, meaning = _decide(c, type_of(df, c), row["rows"], seen, unique[c])
        out.append(
            {
                "name": c,
                "storage_name": storage_name(c),
                "detected_dtype": dtype,
                "semantic_type": meaning,
                "nullable": seen["missing"] > 0,
                "null_count": seen["missing"],
                "unique_count": unique[c],
                "sample_values": firsts[c],
            }
        )
    return out


def _first_values(df: DataFrame, names: list[str]) -> dict[str, list[Any]]:
    """First present values of each column.

    A short head of the table answers most columns; only one that is missing
    there is looked up on its own.
    """
    order = [ROW] if ROW in df.columns else []
    top = df.filter(F.col(ROW) < SAMPLE_HEAD).orderBy(ROW) if order else df.limit(SAMPLE_HEAD)
    rows = top.select(*[present(df, c).alias(c) for c in names]).collect()
    out = {c: [r[i] for r in rows if r[i] is not None][:SAMPLES] for i, c in enumerate(names)}
    for c in [c for c in names if len(out[c]) < SAMPLES and len(rows) >= SAMPLE_HEAD]:
        held = df.filter(~missing(df, c))
        out[c] = [r[0] for r in (held.orderBy(*order) if order else held).select(quoted(c)).limit(SAMPLES).collect()]
    return out


SCHEMA_DDL = (
    "name string, storage_name string, detected_dtype string, semantic_type string, "
    "nullable boolean, null_count long, unique_count long"
)


def schema_table(df: DataFrame, exact: bool = True) -> DataFrame:
    fields = [f.split()[0] for f in SCHEMA_DDL.split(", ")]
    rows = [tuple(c[f] for f in fields) for c in infer_schema(df, exact, samples=False)]
    return df.sparkSession.createDataFrame(rows, SCHEMA_DDL)


STORED = {
    "boolean": T.BooleanType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "datetime": T.TimestampNTZType(),
}


def _stored_as(dtype: str, meaning: str) -> str:
    dtype, meaning = dtype.lower(), meaning.lower()
    if meaning == "boolean" or "bool" in dtype:
        return "boolean"
    if meaning == "integer" or "int" in dtype:
        return "integer"
    if meaning == "float" or any(w in dtype for w in ("float", "double", "decimal")):
        return "float"
    if meaning == "datetime" or "datetime" in dtype:
        return "datetime"
    return meaning if meaning in {"time", "json"} else dtype if dtype in {"time", "json"} else "text"


def coerced(df: DataFrame, name: str, dtype: str, meaning: str) -> Column:
    """The column in its stored type; whatever does not fit becomes NULL."""
    kind, t = _stored_as(dtype, meaning), type_of(df, name)
    if kind == "boolean":
        return parse_bool(df, name)
    if kind == "integer":
        if isinstance(t, T.IntegralType):
            return quoted(name).cast("long")
        v = number(df, name)
        return v.try_cast("long")
    if kind == "float":
        return number(df, name)
    if kind == "datetime":
        return timestamp(df, name)
    if kind == "time":
        return parse_time(df, name)
    if kind == "json":
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(quoted(name))
        token = strip(text(df, name))
        return F.when(F.try_parse_json(token).isNotNull(), token)
    return text(df, name)


def coerce_to_schema(df: DataFrame, schema: list[dict[str, Any]]) -> DataFrame:
    """Project to a schema as given by :func:`infer_schema`; columns the table
    lacks are NULL. Meaning and storage name go into the field metadata."""
    out = [quoted(ROW)] if ROW in df.columns else []
    for col in schema:
        name = col["name"]
        dtype, meaning = str(col.get("detected_dtype", "object")), str(col.get("semantic_type", "categorical"))
        value = coerced(df, name, dtype, meaning) if name in df.columns else F.lit(None).cast(
            STORED.get(_stored_as(dtype, meaning), T.StringType())
        )
        metadata = {"semantic_type": meaning, "storage_name": col.get("storage_name") or storage_name(name)}
        out.append(value.alias(name, metadata=metadata))
    return df.select(*out)


def override_schema(df: DataFrame, schema: list[dict[str, Any]]) -> DataFrame:
    """Apply a user's schema: every entry needs a known column and a meaning."""
    known = {"boolean", "integer", "id", "float", "datetime", "time", "json", "categorical", "text", "unknown"}
    for col in schema:
        if col.get("name") not in df.columns:
            raise ParameterError(f"column {col.get('name')!r} is not in the table")
        if str(col.get("semantic_type", "")).lower() not in known:
            raise ParameterError(f"unknown semantic type {col.get('semantic_type')!r}")
    listed = {c["name"]: c for c in schema}
    full = []
    for name in data_columns(df):
        if name in listed:
            full.append({"detected_dtype": "object", **listed[name]})
        else:
            full.append({"name": name, **dict(zip(("detected_dtype", "semantic_type"), map_type(type_of(df, name).simpleString())))})
    return coerce_to_schema(df, full)


# Database and Spark type names by the type they are read as.
SOURCE_TYPES = {
    ("bool", "boolean"): ("bool", "boolean"),
    ("int64", "integer"): (
        "int2", "int4", "int8", "smallint", "integer", "bigint", "int", "tinyint",
    ),
    ("float64", "float"): ("float4", "float8", "numeric", "decimal", "real", "double precision", "double", "float"),
    ("datetime64[ns]", "datetime"): ("date", "time", "timetz", "timestamp", "timestamptz", "timestamp_ntz"),
    ("object", "json"): ("json", "jsonb"),
}


def map_type(name: str) -> tuple[str, str]:
    token = re.sub(r"\(.*\)", "", str(name or "")).strip().lower()
    return next((kind for kind, names in SOURCE_TYPES.items() if token in names), ("object", "categorical"))


def map_source_types(df: DataFrame) -> list[dict[str, str]]:
    out = []
    for f in df.schema.fields:
        dtype, meaning = map_type(f.dataType.simpleString())
        out.append({"name": f.name, "source_type": f.dataType.simpleString(), "detected_dtype": dtype, "semantic_type": meaning})
    return out


def schema_signature(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name != ROW]

