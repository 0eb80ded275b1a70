"""Sources, sinks, schema inference."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowloom.operators.ordering import with_row_index
from rowloom.queries.book import query
from rowloom.session import shared_dir
from rowloom.sources import files, jdbc, schema, tables


def _scratch(df) -> str:
    return f"{shared_dir(df.sparkSession)}/rowloom/{uuid.uuid4().hex}"


@query(
    "a1_read_csv",
    """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, nullif(c_acctbal, 0) AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment
       FROM customer""",
)
def a1(t):
    c = t("customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    path = _scratch(c)
    files.write_csv(c, path)
    return files.read_csv(c.sparkSession, path)


@query("a2_read_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def a2(t):
    e = t("events").select("event_id", "user_id", "event_type", "value", "props")
    path = _scratch(e)
    files.write_json(e, path)
    return files.read_json(e.sparkSession, path)


@query(
    "a7_sync_tables",
    """SELECT 'nation' AS source_table, 'countries' AS dataset, 'created' AS status, (SELECT count(*) FROM nation) AS rows, FALSE AS broken
       UNION ALL SELECT 'orders', 'orders', 'updated', (SELECT count(*) FROM orders), FALSE
       UNION ALL SELECT 'no_such_table', 'gone', 'failed', NULL, TRUE""",
)
def a7(t):
    spark = t("nation").sparkSession
    mappings = [
        {"source_table": "nation", "dataset_name": "countries"},
        {"source_table": "orders", "dataset_id": "orders"},
        {"source_table": "no_such_table", "dataset_name": "gone"},
        {"source_table": "region", "enabled": False},
    ]
    out = jdbc.sync_tables(spark, mappings, t, _scratch(t("nation")))
    return out.select("source_table", "dataset", "status", "rows", F.col("error").isNotNull().alias("broken"))


@query(
    "a8_write_typed",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(trunc(value) AS BIGINT) END AS whole, value AS exact,
              CASE event_type WHEN 'click' THEN TRUE WHEN 'view' THEN FALSE END AS flag, ts AS moment, props AS doc FROM events""",
)
def a8(t):
    e = t("events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.col("value").cast("string")).alias("whole"),
        F.concat(F.lit(" "), F.col("value").cast("string")).alias("exact"),
        F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "f").otherwise("maybe").alias("flag"),
        F.col("ts").cast("string").alias("moment"),
        F.col("props").alias("doc"),
    )
    wanted = [
        {"name": "event_id", "semantic_type": "integer"},
        {"name": "whole", "semantic_type": "integer"},
        {"name": "exact", "semantic_type": "float"},
        {"name": "flag", "semantic_type": "boolean"},
        {"name": "moment", "semantic_type": "datetime"},
        {"name": "doc", "semantic_type": "json"},
    ]
    return tables.write_typed(e, wanted, _scratch(e))


UPSERT = """b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey, nullif(o_totalprice, 0) AS p FROM orders),
            s AS (SELECT i, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN p + 1 ELSE p END AS p FROM b
                  WHERE i < (SELECT count(*) FROM orders) - 100)"""


def _upserted(t):
    before = with_row_index(t("orders").select("o_orderkey", F.col("o_totalprice").alias("p")), ["o_orderkey"])
    last = t("orders").count() - 100
    after = before.withColumn("p", F.when(F.col("o_orderkey") % 7 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return tables.upsert_by_row_index(before, after.filter(F.col("_row_index") < last))


@query(
    "a10_upsert_by_row_index",
    f"""WITH {UPSERT} SELECT b.i AS _row_index, b.o_orderkey, CASE WHEN s.i IS NULL THEN b.p ELSE s.p END AS p,
          CASE WHEN s.i IS NULL THEN 'deleted' WHEN s.p IS DISTINCT FROM b.p THEN 'upserted' ELSE 'kept' END AS _action
        FROM b LEFT JOIN s ON s.i = b.i""",
)
def a10(t):
    return _upserted(t)


@query(
    "a10_upsert_counts",
    f"""WITH {UPSERT} SELECT count(*) FILTER (s.i IS NOT NULL AND s.p IS DISTINCT FROM b.p) AS upserted_rows,
          count(*) FILTER (s.i IS NULL) AS deleted_rows, count(s.i) AS total_rows FROM b LEFT JOIN s ON s.i = b.i""",
)
def a10_counts(t):
    return tables.upsert_counts(_upserted(t))


@query(
    "a11_read_page",
    """SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_index, o_orderkey, o_custkey FROM orders)
       WHERE _row_index BETWEEN 1000 AND 1199""",
)
def a11(t):
    return tables.read_page(with_row_index(t("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]), 200, 1000)


@query(
    "a12_detect_changed_documents",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status,
              sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS file_hash FROM documents""",
)
def a12(t):
    d = t("documents").select("doc_id", "text")
    new = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tables.detect_changed_documents(d.filter("doc_id % 4 <> 0"), new, "doc_id", "text")


@query("a13_table_hash")
def a13(t):
    return files.table_hash(t("lineitem"))


@query(
    "a14_search_catalog",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')
       OR contains(lower(p_type), 'ring')""",
)
def a14(t):
    c = t("part").select("p_partkey", "p_name", F.col("p_name").alias("name"), F.col("p_brand").alias("folder"), F.array(F.lower("p_type")).alias("columns"))
    return tables.search_catalog(c, " Ring ").select("p_partkey", "p_name")


@query(
    "b1_infer_schema",
    """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS amount, nullif(event_type, 'error') AS kind,
                         CAST(ts AS VARCHAR) AS happened, CAST(CAST(ts AS TIME) AS VARCHAR) AS clock_time, props, value > 5 AS big FROM events)
       SELECT 'event_id' AS name, 'id' AS semantic_type, count(*) - count(event_id) AS null_count, count(DISTINCT event_id) AS unique_count FROM e UNION ALL
       SELECT 'user_id', 'integer', count(*) - count(user_id), count(DISTINCT user_id) FROM e UNION ALL
       SELECT 'amount', 'float', count(*) - count(amount), count(DISTINCT amount) FROM e UNION ALL
       SELECT 'kind', 'categorical', count(*) - count(kind), count(DISTINCT kind) FROM e UNION ALL
       SELECT 'happened', 'datetime', count(*) - count(happened), count(DISTINCT happened) FROM e UNION ALL
       SELECT 'clock_time', 'time', count(*) - count(clock_time), count(DISTINCT clock_time[:8]) FROM e UNION ALL
       SELECT 'props', 'json', count(*) - count(props), count(DISTINCT props) FROM e UNION ALL
       SELECT 'big', 'boolean', count(*) - count(big), count(DISTINCT big) FROM e""",
)
def b1(t):
    e = t("events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("value").cast("string").alias("amount"),
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.col("ts").cast("string").alias("happened"),
        F.date_format("ts", "HH:mm:ss").alias("clock_time"),
        "props",
        (F.col("value") > 5).alias("big"),
    )
    return schema.schema_table(e).select("name", "semantic_type", "null_count", "unique_count")


@query(
    "b2_sanitize_names",
    """SELECT c_custkey AS customer_key, c_name AS customer_key_2, c_nationkey AS c_1st_nation, c_acctbal AS balance FROM customer""",
)
def b2(t):
    c = t("customer").toDF("Customer Key", "customer__key!", "1st nation", " BALANCE ", "seg")
    return schema.sanitize_columns(c).drop("seg")


WORDS = """CASE event_id % 8 WHEN 0 THEN ' Yes' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN NULL
           WHEN 5 THEN '9:05 pm' WHEN 6 THEN '23:59:01' ELSE '07:30' END"""


def _words(t):
    n = F.col("event_id") % 8
    return t("events").select(
        "event_id",
        F.when(n == 0, " Yes").when(n == 1, "F").when(n == 2, "1").when(n == 3, "maybe").when(n == 5, "9:05 pm")
        .when(n == 6, "23:59:01").when(n == 7, "07:30").alias("w"),
    )


@query(
    "b3_parse_bool",
    f"SELECT event_id, CASE lower(trim({WORDS})) WHEN 'yes' THEN TRUE WHEN '1' THEN TRUE WHEN 'f' THEN FALSE END AS flag FROM events",
)
def b3(t):
    from rowloom.functions.guards import parse_bool

    w = _words(t)
    return w.select("event_id", parse_bool(w, "w").alias("flag"))


@query(
    "b4_parse_time",
    f"SELECT event_id, CASE {WORDS} WHEN '9:05 pm' THEN '21:05:00' WHEN '23:59:01' THEN '23:59:01' WHEN '07:30' THEN '07:30:00' END AS clock FROM events",
)
def b4(t):
    from rowloom.functions.guards import parse_time

    w = _words(t)
    return w.select("event_id", parse_time(w, "w").alias("clock"))


@query(
    "b5_parse_datetime",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts)
              WHEN 3 THEN date_trunc('day', ts) END AS moment FROM events""",
)
def b5(t):
    from rowloom.functions.guards import timestamp

    n = F.col("event_id") % 5
    e = t("events").select(
        "event_id",
        F.when(n == 0, F.col("ts").cast("string"))
        .when(n == 1, F.date_format("ts", "MM/dd/yyyy"))
        .when(n == 2, F.date_format("ts", "M/d/yyyy HH:mm"))
        .when(n == 3, F.date_format("ts", "yyyy/MM/dd"))
        .otherwise("not a date")
        .alias("m"),
    )
    return e.select("event_id", timestamp(e, "m").alias("moment"))


@query("b6_parse_json", "SELECT event_id, event_id % 3 <> 0 AS is_json FROM events")
def b6(t):
    from rowloom.functions.guards import text_is_json

    e = t("events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "props")).when(F.col("event_id") % 3 == 2, "[1, null]").otherwise("{k: ").alias("p"),
    )
    return e.select("event_id", text_is_json(F.col("p")).alias("is_json"))


@query(
    "b7_coerce_to_schema",
    """SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS price, CAST(p_size AS DOUBLE) AS size, CAST(NULL AS BOOLEAN) AS name FROM part""",
)
def b7(t):
    p = t("part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    wanted = [("p_partkey", "integer"), ("price", "integer"), ("size", "float"), ("name", "boolean")]
    return schema.coerce_to_schema(p, [{"name": n, "semantic_type": s} for n, s in wanted])


@query(
    "b9_override_schema",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal FROM customer",
)
def b9(t):
    c = t("customer").drop("c_mktsegment")
    return schema.override_schema(c, [{"name": "c_custkey", "semantic_type": "id", "detected_dtype": "string"}, {"name": "c_nationkey", "semantic_type": "float"}])
