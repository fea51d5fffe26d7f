"""Registered queries that write rows of the given tables to a store and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .catalog import query, table

_RECORD = """case o_orderkey % 11 when 3 then concat('{"id": ', o_orderkey, ', "note": "cut') when 5 then concat('{"id": "x', o_orderkey, '", "note": "kind"}') when 7 then concat('no json ', o_orderkey)
  when 8 then concat('{"id": ', o_orderkey, ', "note": null, "more": [1, {"a": 2}]}') else concat('{"id": ', o_orderkey, ', "note": "', o_orderpriority, ' \\\\"q\\\\""}') end"""


@query(
    f"""with r as (select o_orderkey as k, o_orderkey % 11 as m, concat('2024', o_orderkey % 3) as ts, o_orderstatus as t, substr(o_orderpriority, 1, 1) as c, o_orderpriority as p, {_RECORD.replace(chr(92) * 4, chr(92))} as v from orders)
    select case when m in (3, 5, 7) then 'damaged' else 'good' end as state, ts, t as table_name, c as class_name, case when m not in (3, 5, 7) then k end as id, case when m not in (3, 5, 7, 8) then p || ' "q"' end as note, case when m in (3, 5, 7) then sha256(v) end as digest from r"""
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all orders, written as nested JSON results, one in four of them damaged, read with a quarantine."""
    folder = store.shared_folder(spark, "results")
    rows = table(spark, sf_dir, "orders").select(F.expr(_RECORD).alias("value"), F.expr("concat('2024', o_orderkey % 3)").alias("ts"), F.col("o_orderstatus").alias("t"), F.expr("substr(o_orderpriority, 1, 1)").alias("c"))
    rows.write.partitionBy("ts", "t", "c").text(f"{folder}/text")
    good, bad = store.quarantined(spark, f"{folder}/text", "id long, note string", f"{folder}/split", pattern="part-*")
    return good.select(F.lit("good").alias("state"), "ts", "table_name", "class_name", "id", "note").unionByName(bad.select(F.lit("damaged").alias("state"), "ts", "table_name", "class_name", "digest"), allowMissingColumns=True)


@query(
    """select 'nations' as section, n_name as name, cast(count(c_custkey) as bigint) as n, cast(null as boolean) as rich from nation left join customer on c_nationkey = n_nationkey group by n_name
    union all select case when c_custkey % 9 = 0 then null else c_mktsegment || ' "/" ' end, c_name || chr(10) || ',"' || case when c_custkey % 2 = 0 then '' else 'x' end, case when c_custkey % 5 = 0 then null else c_custkey end, c_acctbal > 0 from customer"""
)
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of all customers and nations, written in sections and read back; the version before it stays unread."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    counted = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("n")).withColumn("section", F.lit("nations"))
    each = customer.select(F.expr("case when c_custkey % 9 = 0 then null else c_mktsegment || ' \"/\" ' end").alias("section"), F.expr("c_name || '\\n,\"' || if(c_custkey % 2 = 0, '', 'x')").alias("name"), F.expr("if(c_custkey % 5 = 0, null, c_custkey)").alias("n"), F.expr("c_acctbal > 0").alias("rich"))
    folder = store.shared_folder(spark, "report")
    columns = ["section", "name", "n", "rich"]
    store.write_report(each.select(*columns), folder, "section", ["name"])
    store.write_report(counted.withColumn("rich", F.lit(None).cast("boolean")).select(*columns).unionByName(each), folder, "section", ["name"])
    return store.read_report(spark, folder, "section string, name string, n long, rich boolean")
