"""Filled fields and file groups on odd rows: nulls, repeats, empty tables."""

import random

from pyspark.sql import functions as F

from lineloom.operators import contexts, fill, graph


def test_endpoints_go_to_empty_methods_in_order(spark):
    methods = [("a.X.m", 1), ("b.X.m", 2), ("c.m", 3), ("a.X.m", 4), ("n", 5), (None, 6), ("d.k", 7)]
    points = [("z.m", "/1", 1), ("b.X.m", "/2", 2), ("b.X.m", "/3", 3), ("y.m", "/4", 4), ("x.m", "/5", 5), ("w.m", "/6", 6), ("n", "", 7), (None, "/7", 8), ("q.k", "/8", 9)]
    got = fill.endpoints_into_methods(spark.createDataFrame(methods, "method string, ord int"), spark.createDataFrame(points, "method string, path string, ord int"))
    assert {r.ord: r.end_point for r in got.collect()} == {1: "/1", 2: "/3", 3: "/4", 4: "/5", 5: None, 6: None, 7: "/8"}
    assert fill.endpoints_into_methods(spark.createDataFrame(methods, "method string, ord int"), spark.createDataFrame([], "method string, path string, ord int")).where("end_point is not null").count() == 0
    counts = spark.createDataFrame([("/x/4", 7, 1)], "path string, access_cnt long, ord int")
    assert {r.ord: r.access_cnt for r in fill.final_access(got, counts).collect()} == {1: 0, 2: 0, 3: 7, 4: 0, 5: 0, 6: 0, 7: 0}


def test_a_name_that_all_share_is_numbered_as_by_hand(spark):
    r = random.Random(2)
    methods, points = [(f"{r.choice('abc')}{i}.m", i) for i in r.sample(range(999), 300)], [(f"z{i}.m", f"/{i}", i) for i in r.sample(range(999), 200)]
    got = fill.endpoints_into_methods(spark.createDataFrame(methods, "method string, ord int"), spark.createDataFrame(points, "method string, path string, ord int"))
    want = dict(zip(sorted(o for _, o in methods), [f"/{i}" for i in sorted(i for *_, i in points)]))
    assert {x.ord: x.end_point for x in got.collect()} == {o: want.get(o) for _, o in methods}


def test_batch_contexts(spark):
    bats = spark.createDataFrame([("p/bat/A.java", "p", ["x.VoOne", "y.Z"]), ("p/bat/B.java", "p", ["y.Z"]), ("p/bat/B.java", "p", ["y.Z"]), ("q/C.java", "q", None), ("p/D.java", "p", []), (None, None, ["a"])], "path string, project string, imports array<string>")
    values = spark.createDataFrame([("p/vo/voone.java", "p"), ("p/vo/Other.java", "p"), (None, "p"), ("r/V.java", "r")], "path string, project string")
    queries = spark.createDataFrame([("p/xml/A_SQL.xml",), ("p/A_SQL.xml",), ("q/C_SQL.xml",), ("xml/D_SQL.xml",), (None,)], "path string")
    got = {tuple(r) for r in contexts.batch_contexts(bats, values, queries).collect()}
    assert got == {("p/bat/A.java", "vo", "p/vo/voone.java"), ("p/bat/B.java", "all vo", None), ("p/D.java", "all vo", None), ("p/bat/A.java", "xml", "p/A_SQL.xml"), ("q/C.java", "xml", "q/C_SQL.xml")}
    assert contexts.batch_contexts(bats.limit(0), values.limit(0), queries.limit(0)).count() == 0


def test_layers_utilities_and_backups(spark):
    files = spark.createDataFrame([("T", "Dao", "a", 5), ("T", "DAO", "a", 5), ("T", "dao", "b", None), ("T", "dao", "c", 9), (None, None, "d", 1)], "table_name string, layer string, path string, tokens int")
    assert {tuple(r) for r in contexts.layer_batches(files, 1, 1, 8).collect()} == {("T", "dao", "a", 0), ("T", "dao", "b", 0), ("T", "dao", "c", 1), (None, None, "d", 0)}
    types = spark.createDataFrame([("r/src/a/b/C.java", "a.b", ["u.MyUtil", "u.*", "u.Plain"]), ("x/C.java", "a.b", ["u.MyUtil"]), ("C.java", "", ["u.MyUtil"]), ("a/b/D.java", "a.b", ["u.MyUtil"]), ("n.java", None, None)], "path string, package string, imports array<string>")
    known = spark.createDataFrame([("r/src/u/MyUtil.java",), ("r/src/u/Plain.java",), ("u/MyUtil.java",), ("/u/MyUtil.java",)], "path string")
    assert {tuple(r) for r in contexts.utility_files(types, known, ["UTIL"]).collect()} == {("r/src/a/b/C.java", "r/src/u/MyUtil.java"), ("C.java", "u/MyUtil.java"), ("a/b/D.java", "u/MyUtil.java")}
    copies = spark.createDataFrame([("f",), ("f.backup",), ("f.backup.12",), ("g.backup",), ("f",), (None,), ("f.backup.x",)], "path string")
    assert {tuple(r) for r in contexts.backups(copies).collect()} == {("f", "f.backup", 0), ("f", "f.backup.12", 12)}


def test_targets_and_change_rows(spark):
    rows = spark.createDataFrame([(1, "T"), (2, "U"), (3, None)], "i int, table_name string")
    watched = spark.createDataFrame([("T", "b", "Name", 2), ("T", "a", None, 1), ("T", "c", "", 3), ("T", "d", "name", 4), ("V", "x", "rrn", 1)], "table_name string, column_name string, column_type string, ord int")
    got = fill.with_targets(rows, watched).withColumn("shown", fill.shortened(F.col("target_columns")))
    assert {r.i: (r.target_columns, r.name_only, r.shown) for r in got.collect()} == {1: (["a", "b", "c", "d"], True, "a, b, c..."), 2: ([], True, ""), 3: ([], True, "")}
    assert fill.with_targets(spark.createDataFrame([(1, "V")], "i int, table_name string"), watched).first().name_only is False
    files, none = spark.createDataFrame([("f",), ("f",), ("g",)], "path string"), spark.createDataFrame([], "path string, line int, text string, end_point string, column string, at int")
    lines = spark.createDataFrame([("f", 9, " @Encrypted x "), ("f", 3, "encrypt (no)"), ("f", None, "decrypt(y)"), ("g", 1, None)], "path string, line int, text string")
    assert {tuple(r) for r in fill.change_rows(files, lines, none, none).collect()} == {("f", 2, None, "decrypt(y)", None, None), ("g", 0, None, None, None, None)}
    named = spark.createDataFrame([("a",), ("b",)], "name string")
    assert fill.only_named(named, named.where("name = 'a'")).count() == 1 and fill.only_named(named, named.limit(0)).count() == 2


def test_start_nodes(spark):
    edges = spark.createDataFrame([("x.A.f", "B.g"), ("B.g", "C.g"), ("A.f", "D.h")], "caller string, callee string")
    wanted = spark.createDataFrame([("A.f",), ("g",), ("Z.h",), ("f",), ("none",), (None,)], "wanted string")
    assert {tuple(r) for r in graph.start_nodes(edges, wanted).collect()} == {("A.f", "A.f"), ("g", "B.g"), ("Z.h", "D.h"), ("f", "A.f")}
