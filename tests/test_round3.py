"""Findings of round 3: each failed before its change."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from lineloom.operators import batching, fill, graph, lineage, prefix


def by_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(repr, con.execute(__spark_entry__.oracle_sql()[name]).fetchall()))


def test_layer_batches_rounds_halves_as_its_sql_does(spark, tmp_path):
    # one group: 898 or 899 tokens each until the batch is nearly full, then none or one
    rows = [(100 + 2 * i, 0, "O", 898.5 if i < 22 else 0.5, None, "1-URGENT") for i in range(82)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = __spark_entry__.queries()["layer_batches"](spark, str(tmp_path)).select("table_name", "layer", "path", "batch").collect()
    assert sorted(repr(tuple(r)) for r in got) == by_sql(tmp_path, "layer_batches", "orders")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_groups_are_scanned_without_joins_or_arrays(spark):
    d = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5)], "k string, at int, n int")
    out = prefix.as_of(prefix.running_sum(d, ["k"], "at", F.col("n"), "s", last=9, unique=True), ["k"], "at", F.col("n"), "p", last=9, unique=True)
    assert "Join" not in plan(out) and "collect_list" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 1, 2, 0, None), ("a", 2, 3, 2, 2), ("b", 1, 5, 0, None)]


def test_relations_of_a_scope_need_no_join(spark):
    d = spark.createDataFrame([("q", "#", "SELECT a.X AS Y, Z FROM A a, B UNION SELECT C, * FROM D")], "sql_id string, scope string, text string")
    out = lineage.relations(d)
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.select("name", "source", "column").collect()), key=str) == [("Y", "A", "X"), ("Y", "D", "C"), ("Z", "D", "*"), ("Z", None, "Z")]


def test_final_access_sends_no_table_to_the_driver(spark):
    rows = spark.createDataFrame([("m", "/a/b"), ("n", "")], "method string, end_point string")
    out = fill.final_access(rows, spark.createDataFrame([("/v/a/b", 7, 1)], "path string, access_cnt long, ord int"))
    assert "BroadcastHashJoin" not in plan(out.where("access_cnt > 0").select("method")).split("Initial Plan")[-1]
    assert sorted(map(tuple, out.select("method", "access_cnt").collect())) == [("m", 7), ("n", 0)]


def test_budget_select_takes_a_phase_for_each_digit_not_for_each_skip(spark, monkeypatch):
    sizes = [100] + [x for i in range(1, 40) for x in (1, 1000 - 100 - i + 1)]
    room, want = 1000, []
    for i, t in enumerate(sizes):
        if t <= room:
            room, want = room - t, [*want, i]
    calls, own = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: calls.append(1) or own(self, *a))
    d = spark.createDataFrame([("g", i, t) for i, t in enumerate(sizes)], "g string, o int, t int")
    got = batching.budget_select(d, "g", "o", "t", 1000)
    assert sorted(x.o for x in got.collect()) == want and len(calls) <= 2 * 11 + 2


def test_start_nodes_meet_one_row_for_each_ending(spark):
    edges = spark.createDataFrame([(f"S{i}.load", f"T{i}.run") for i in range(30)], "caller string, callee string")
    out = graph.start_nodes(edges, spark.createDataFrame([(f"x.y{i}.load",) for i in range(30)] + [("S3.load",)], "wanted string"))
    assert {r.wanted: r.node for r in out.collect()} == {f"x.y{i}.load": "S0.load" for i in range(30)} | {"S3.load": "S3.load"}
