from pyspark.sql import functions as F

from lineloom.functions import javatext
from lineloom.operators import reports


def test_calls_by_depth(spark):
    code = """void a() { K . encrypt(x); // K.encrypt(y) in { a comment
      String s = "for (;;) { K.encrypt( http://x"; char c = '{';
      for (A a : all) { K.encrypt(a); while (b) { K.encrypt(b); for (;;) { K.decrypt(c); } } }
      MyK.encrypt(z); x.K.decrypt(z); }"""
    rows = [("m", code), ("open", "for (;;) { K.encrypt(x);"), ("null", None), ("empty", ""), ("late", "for (;;) x(); if (y) { K.encrypt(x); }"), ("long", "{" * 3 + "K.encrypt(x);" * 20_000 + "}" * 3)]
    d = spark.createDataFrame(rows, "id string, code string").select("id", reports.calls_by_depth(F.col("code"), ["K.encrypt", "K.decrypt", "K.encrypt"]).alias("c"))
    got = {r.id: tuple(r.c) for r in d.collect()}
    assert got == {"m": (2, 1, 2, 3, 5), "open": (1, 0, 0, 0, 1), "null": (0,) * 5, "empty": (0,) * 5, "late": (0, 1, 0, 1, 1), "long": (20_000, 0, 0, 0, 20_000)}


def test_code_keeps_its_lines(spark):
    code = 'a("x\\"//y"); /* b\n */ c(\'"\'); // d\ne /* f\n'
    got = spark.createDataFrame([(code,)], "s string").select(javatext.code_only(F.col("s")), javatext.code_only(F.col("s"), literals=True)).first()
    assert tuple(got) == ('a(""); \n c(\'\'); \ne \n', 'a("x\\"//y"); \n c(\'"\'); \ne \n')


def test_endpoint_of_methods(spark):
    e = spark.createDataFrame([("A.x", "/1", 1), ("A.x", "/2", 2), ("B.x", "/3", 3), ("C.y", "", 4), (None, "/5", 5)], "method string, path string, ord int")
    m = spark.createDataFrame([("A.x",), ("A.x",), ("Z.x",), ("C.y",), ("B.x",), (None,)], "method string")
    assert {tuple(r) for r in reports.endpoint_of_methods(m, e).collect()} == {("A.x", "/2"), ("Z.x", "/2"), ("C.y", None), ("B.x", "/3"), (None, None)}


def test_stacks_and_fields(spark):
    s = spark.createDataFrame([([["A.x", "B.y"], ["A.x"], [" C.z "], [], None, [None], [""]],)], "s array<array<string>>")
    assert s.select(reports.first_frames(F.col("s"))).first()[0] == "A.x,\nC.z"
    stacks = spark.createDataFrame([(["A.x", "Q.y"],), (["A.x", "Q.y"],), (["Q.y", "A.x"],), (["A"],), ([],), (None,)], "stack array<string>")
    files = spark.createDataFrame([("src/A.java",), ("A.kt",), ("src/b/AA.java",), (None,)], "path string")
    assert sorted(r.stack for r in reports.relevant_stacks(stacks, files).collect()) == [["A"], ["A.x", "Q.y"]]
    f = spark.createDataFrame([(["b", "a", " b"], ["c", "a", None]), (None, ["x"]), (None, None)], "i array<string>, o array<string>")
    assert [r[0] for r in f.select(reports.crypto_fields(F.col("i"), F.col("o"))).collect()] == ["b, a, c", "x", ""]


def test_mapped_methods(spark):
    known = spark.createDataFrame([("n.s", "D", "run", "q1", 1), ("n.s", "E", "go", "q1", 2), ("n.s", "E", "q2", "q9", 3)], "namespace string, class_name string, method string, sql_id string, ord int")
    s = spark.createDataFrame([("n.s", "q1"), ("n.s", "q1"), ("n.s", "q2"), ("n.s", "q3"), ("m.t", "q1"), ("u", "q1")], "namespace string, sql_id string")
    got = {tuple(r) for r in reports.mapped_methods(s, known).collect()}
    assert got == {("n.s", "q1", "D", "run"), ("n.s", "q2", "E", "q2"), ("n.s", "q3", "s", "q3"), ("m.t", "q1", "t", "q1"), ("u", "q1", "u", "q1")}
