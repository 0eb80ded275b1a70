"""Files, schemas, stored tables, guards of database queries."""

import json

import pytest
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError
from rowloom.operators.ordering import with_row_index
from rowloom.sources import files, jdbc, schema, tables


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,name,score,when,flag\n1,"a ""b""\nc",1.5,2024-01-02,yes\n2,NA,,2024-02-03,no\n3,x,2,2024-03-04,true\n')
    df = files.read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double", "timestamp_ntz", "boolean"]
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == 'a "b"\nc' and rows[1]["name"] is None and rows[1]["score"] is None


@pytest.mark.parametrize("array", [True, False])
def test_json_forms(spark, tmp_path, array):
    data = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(data, indent=1) if array else "\n".join(json.dumps(d) for d in data))
    assert [tuple(r) for r in files.read_json(spark, str(path)).orderBy("a").collect()] == [(1, "x"), (2, None)]


def test_file_hash(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = files.file_hashes(spark, str(tmp_path)).first()
    assert row["sha256"].startswith("ba7816bf") and row["size"] == 3


def test_table_hash_ignores_order(table):
    c = table("customer")
    assert files.table_hash(c).first() == files.table_hash(c.repartition(5).orderBy(F.desc("c_name"))).first()
    assert files.table_hash(c).first() != files.table_hash(c.filter("c_custkey > 1")).first()


def test_names():
    got = schema.sanitize_names(["A b", "a_b", "1x", "__", "_row_index", "ü" * 3, "x" * 80])
    assert got[:4] == ["a_b", "a_b_2", "c_1x", "col"]
    assert got[4] == "row_index" and len(got[6]) == 55


def test_inference(spark):
    uuid = "123e4567-e89b-12d3-a456-4266141740%02d"
    rows = [
        (i, f"{i}", f"{i}.5", "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", f"{i % 24}:30", '{"a": 1}', uuid % i, f"k{i % 3}", f"free text {i}", None)
        for i in range(60)
    ]
    ddl = "user_id long, n string, x string, b string, d string, start_time string, j string, u string, c string, t string, e string"
    found = {c["name"]: c["semantic_type"] for c in schema.infer_schema(spark.createDataFrame(rows, ddl))}
    assert found == {
        "user_id": "id", "n": "integer", "x": "float", "b": "boolean", "d": "datetime", "start_time": "time", "j": "json",
        "u": "id", "c": "categorical", "t": "text", "e": "unknown",
    }


def test_schema_metadata(table):
    out = schema.override_schema(table("region"), [{"name": "r_regionkey", "semantic_type": "float"}])
    assert out.schema["r_regionkey"].metadata["semantic_type"] == "float"
    with pytest.raises(ParameterError):
        schema.override_schema(table("region"), [{"name": "nope", "semantic_type": "float"}])


def test_map_types(table):
    assert schema.map_type("decimal(10,2)") == ("float64", "float")
    assert [c["semantic_type"] for c in schema.map_source_types(table("events"))] == [
        "integer", "datetime", "integer", "categorical", "float", "categorical",
    ]


@pytest.mark.parametrize("sql", ["DELETE FROM t", "select 1; drop table t", "with x as (delete from t) select 1", "", "copy t"])
def test_queries_that_write_are_refused(sql):
    with pytest.raises(ParameterError):
        jdbc.check_read_only(sql)


def test_queries_that_read_pass():
    assert jdbc.check_read_only(" SELECT create_date, replace(a, 'x', 'y') FROM t; ") == "SELECT create_date, replace(a, 'x', 'y') FROM t"
    assert jdbc.check_table_name("s.t") == "s.t"
    for bad in ("t; drop", "a.b.c", "1t", ""):
        with pytest.raises(ParameterError):
            jdbc.check_table_name(bad)


def test_catalog_listing(spark, table):
    table("nation").createOrReplaceTempView("nation_view")
    assert "nation_view" in [r["table_name"] for r in jdbc.list_tables(spark).collect()]
    rows = jdbc.table_schema(spark, "nation_view").collect()
    assert [(r["column_name"], r["data_type"]) for r in rows] == [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]


def test_save_and_merge(spark, table, tmp_path):
    base = with_row_index(table("nation"), ["n_nationkey"])
    first = tables.save(base, str(tmp_path), 1)
    assert first["rebuilt"] and first["total_rows"] == 25
    stored = spark.read.parquet(first["path"])
    edited = stored.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name"))).filter("_row_index < 20")
    second = tables.save(edited, str(tmp_path), 2, stored)
    assert (second["rebuilt"], second["upserted_rows"], second["deleted_rows"], second["total_rows"]) == (False, 1, 5, 20)
    third = tables.save(edited.drop("n_name"), str(tmp_path), 3, spark.read.parquet(second["path"]))
    assert third["rebuilt"]


def test_search_catalog(spark):
    rows = [("Sales 2024", None, ["amount"]), ("other", "Finance", ["Sales_id"]), ("x", "y", ["z"])]
    catalog = spark.createDataFrame(rows, "name string, folder string, columns array<string>")
    assert tables.search_catalog(catalog, "SALES").count() == 2
    assert tables.search_catalog(catalog, "default").count() == 1
    assert tables.search_catalog(catalog, "", "Finance").count() == 1
