"""What reading literal sources and statements by hand gives."""

import by_hand as J
import pytest
from pyspark.sql import functions as F

from lineloom.functions import classify, sqltext
from lineloom.operators import access, reports, resolve
from lineloom.sources import javaparse


@pytest.fixture(scope="module")
def types(spark):
    return javaparse.types(spark.createDataFrame(J.JAVA, "path string, text string"))


def test_types_and_methods(types):
    got = types.select("path", "class_name", "kind", F.coalesce("superclass", F.lit("")), F.array_join("interfaces", ","))
    assert sorted(map(tuple, got.collect())) == sorted(J.CLASSES)
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ",")
    got = javaparse.methods(types).select("class_name", "name", "return_type", params, F.array_join("calls", " "), "start_line", "end_line")
    assert sorted(map(tuple, got.collect())) == sorted(J.METHODS)


def test_edges(types):
    direct = resolve.call_edges(types, javaparse.methods(types))
    assert sorted(map(tuple, direct.select("caller", "callee", "callee_file").collect())) == sorted(J.EDGES)
    assert sorted(map(tuple, resolve.expand_interfaces(direct, types).select("caller", "callee", "callee_file").collect())) == sorted(J.EDGES + J.MORE_EDGES)


def test_layers_and_data_types(types):
    of = F.transform("fields", lambda x: x["type"])
    got = types.select("class_name", classify.layer(F.col("class_name"), F.col("package"), F.col("annotations"), F.col("interfaces"), of))
    assert sorted(map(tuple, got.collect())) == sorted(J.CLASS_LAYERS)
    got = javaparse.methods(types).select("class_name", "name", classify.data_type(F.col("return_type"), F.col("params"), F.lit("SELECT 1")))
    assert sorted(map(tuple, got.collect())) == sorted(J.DATA_TYPES)


def test_select_items_and_aliases(spark):
    s = spark.createDataFrame(J.SELECTS, "sql_id string, sql string")
    got = s.select("sql_id", F.explode(sqltext.select_items(F.col("sql"))).alias("i")).select("sql_id", F.coalesce("i.column", F.lit("")), F.coalesce("i.alias", F.lit("")))
    assert sorted(map(tuple, got.collect())) == sorted(J.ITEMS)
    got = s.select("sql_id", F.explode(sqltext.columns_by_alias(F.col("sql"), F.array(F.lit("NAME"), F.lit("AGE")))).alias("i")).select("sql_id", "i.column", "i.alias")
    assert sorted(map(tuple, got.collect())) == sorted(J.TARGETS)


def test_calls_by_depth(spark):
    code = spark.createDataFrame(J.CRYPTO_CODE, "name string, code string")
    assert sorted(map(tuple, code.select("name", reports.calls_by_depth(F.col("code"), J.CRYPTO_NAMES).alias("c")).select("name", "c.*").collect())) == sorted(J.CRYPTO_DEPTHS)


def test_watched_statements(spark):
    s = spark.createDataFrame(J.STATEMENTS, "sql_id string, file string, sql string")
    got = access.watched_access(s, spark.createDataFrame(J.WATCHED, "table_name string, column_name string, new_column boolean"))
    assert sorted((r.sql_id, r.table_name) for r in got.collect()) == [
        ("s01", "CUSTOMER"), ("s02", "CUSTOMER"), ("s03", "CUSTOMER"), ("s03", "ORDERS"), ("s04", "CUSTOMER"), ("s05", "ORDERS"), ("s06", "ORDERS"), ("s07", "CUSTOMER"), ("s10", "SUPPLIER"), ("s11", "SUPPLIER"), ("s13", "CUSTOMER"),
    ]
