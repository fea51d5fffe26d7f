"""Lineage operators on small literal inputs, and every registered query against its SQL twin."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from lineloom.functions import classify, javatext, sqltext
from lineloom.operators import access as acc
from lineloom.operators import batching, graph, resolve
from lineloom.plans.catalog import ORACLE, QUERIES
from lineloom.sources import javaparse

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = lambda v: float(v) if isinstance(v, (decimal.Decimal, float)) else v
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    q = con.execute(ORACLE[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(dict(zip(names, r))[c]) for c in cols]) for r in q.fetchall())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


def test_tables_and_columns(spark):
    sql = "INSERT INTO app.users (id, name) VALUES (1, 2)"
    r = spark.createDataFrame([(sql,)], "sql string").select(sqltext.table_names(F.col("sql")), sqltext.qualified_tables(F.col("sql")), sqltext.column_names(F.col("sql"), F.lit("USERS")), sqltext.query_type(F.col("sql"))).first()
    assert list(r) == [["USERS"], ["app.users"], ["ID", "NAME"], "INSERT"]


def test_reach_ends_in_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "caller string, callee string")
    got = {(r.node, r.depth) for r in graph.reach(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in graph.cycles(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_long_cycles(spark):
    ring = [(f"m{i:02}", f"m{(i + 1) % 45:02}") for i in range(45)]
    e = spark.createDataFrame([*ring, ("m07", "m07"), ("m03", "out"), ("out", "x"), ("x", "out"), ("in", "m00"), ("self", "self")], "caller string, callee string")
    assert {tuple(r) for r in graph.cycles(e).collect()} == {*((a, "m00") for a, _ in ring), ("out", "out"), ("x", "out")}


def test_batches_never_pass_the_budget_unless_alone(spark):
    d = spark.createDataFrame([("g", i, t) for i, t in enumerate([50, 60, 500, 10, 10])], "g string, i int, t int")
    got = [tuple(r) for r in batching.greedy_batches(d, "g", "i", "t", prompt=0, separator=1, budget=100).orderBy("i").collect()]
    assert got == [("g", 0, 0), ("g", 1, 1), ("g", 2, 2), ("g", 3, 3), ("g", 4, 3)]
    assert [r.i for r in batching.budget_select(d, "g", "i", "t", budget=75).orderBy("i").collect()] == [0, 3, 4]


def test_comments_in_strings_stay(spark):
    rows = [("SELECT '--x' FROM t -- y\nWHERE a = '/* b */' /* c\n d */ AND e = 'it''s'",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "sql string").select(sqltext.without_comments(F.col("sql"))).collect()]
    assert got == ["SELECT '--x' FROM t WHERE a = '/* b */' AND e = 'it''s'", None, ""]


def test_call_tree_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c")], "caller string, callee string")
    tree = graph.call_tree(e, spark.createDataFrame([("a",)], "node string"), max_depth=3)
    assert sorted((">".join(r.path), r.is_circular) for r in tree.collect()) == [("a", False), ("a>b", False), ("a>b>a", True), ("a>b>c", False), ("a>c", False)]
    assert [r.line for r in graph.printed(tree).orderBy("place").collect()] == ["a", "  b", "    a (circular)", "    c", "  c"]
    assert {tuple(r) for r in graph.edges_of_paths(tree.where("not is_circular")).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}


def test_java_parser_reads_odd_sources(spark):
    src = """package a; import b.C; import static d.E.*;
/* class Fake { } */ @X({"}", "{"}) public class U<T extends F> extends Base<T> implements A, b.D<X> {
  private final S s = new S(1, "a;b{"); @I private Map<String, List<V>> c, o;
  public U(S s) { this.s = s; help(); }
  @G(value = "/{id}") public V[] get(@P("id") final Long id, int... xs) throws E {
    V u = s.find(id).map(x -> x.copy()).orElse(null);
    for (O o : u.all()) { this.c.put(o.key(), new ArrayList<V>().size()); if (ok(o)) return super.get(id); } }
  static { boot(); } <R> List<R> list() { return null; } interface N { void run(String s); }
  enum K { A(1) { void z() {} }, B; int k; K of(int n) { return valueOf("A"); } } }"""
    t = javaparse.types(spark.createDataFrame([("p", src), ("n", None), ("e", ""), ("half", "class H { void m() { x.y(")], "path string, text string"))
    got = {r.class_name: r for r in t.collect()}
    assert set(got) == {"U", "N", "K", "H"} and got["U"].interfaces == ["A", "b.D"] and got["U"].superclass == "Base" and got["U"].imports == ["b.C", "d.E.*"]
    assert [tuple(f) for f in got["U"].fields] == [("S", "s"), ("Map<String,List<V>>", "c"), ("Map<String,List<V>>", "o")]
    m = {x.name: x for x in got["U"].methods}
    assert set(m) == {"get", "list"} and m["get"].return_type == "V[]" and [tuple(p) for p in m["get"].params] == [("Long", "id"), ("int[]", "xs")]
    assert m["get"].calls == ["s.find", "s.map", "x.copy", "s.orElse", "u.all", "c.put", "o.key", "ArrayList.size", "ok", "get"] and [tuple(v) for v in m["get"].locals] == [("V", "u"), ("O", "o")]
    assert [x.name for x in got["K"].methods] == ["of"] and got["H"].methods[0].calls == ["x.y"]


def test_names_by_pattern(spark):
    src = 'public class A { static private int[] xs = f(1); @B("q") List<X> ys; final static <T> Map<A, B> m(int a, B<C> b) throws E { return g(a); new Foo(x); String s = "class Z"; A.class.x(); } abstract void n(); }'
    r = spark.createDataFrame([(src,)], "s string").select(javatext.class_names(F.col("s")), javatext.method_names(F.col("s")), javatext.field_names(F.col("s"))).first()
    assert list(r) == [["A"], ["m", "n"], ["xs", "ys"]]


def test_fallback_join_and_class_resolution(spark):
    left = spark.createDataFrame([("T", "ns.find", 1), ("T", "other.find", 2), ("T", "gone", 3), ("X", "find", 4)], "t string, q string, i int")
    right = spark.createDataFrame([("T", "NS.FIND", "exact", 2), ("T", "zz.find", "tail", 1)], "t string, q string, v string, o int")
    assert {(r.i, r.v) for r in acc.with_fallback(left, right, ["t"], "q", "o").collect()} == {(1, "exact"), (2, "tail")}
    types = spark.createDataFrame([("b/U.java", "b.U", "U"), ("a/U.java", "a.U", "U")], "path string, full_name string, class_name string")
    names = spark.createDataFrame([("b.U",), ("U",), ("x.y.U",), ("None",)], "name string")
    assert {tuple(r) for r in resolve.resolve_class(names, types).collect()} == {("b.U", "b/U.java"), ("U", "a/U.java"), ("x.y.U", "a/U.java"), ("None", None)}


def test_types_and_weights(spark):
    rows = [("Page<X>", "", "single"), ("X", "SELECT 1 LIMIT 3", "x"), (None, "rownum", "x"), ("Set<X>", "LIMIT", "x"), ("guestlist", "", "x"), (None, None, "x")]
    d = spark.createDataFrame(rows, "rt string, s string, p string")
    none = F.expr("cast(null as array<struct<type:string,name:string>>)")
    assert [r[0] for r in d.select(classify.data_type(F.col("rt"), none, F.col("s"))).collect()] == ["paged_list", "paged_list", "paged_list", "unpaged_list", "single", "single"]
    assert [r[0] for r in d.select(classify.data_type_inline(F.col("rt"), F.col("s"))).collect()] == ["paged_list", "single", "paged_list", "single", "single", "single"]
    one = spark.createDataFrame([('so: ```json\n{"a": [1,],}\n``` ok', 'x {"b": 2} y', "no")], "a string, b string, c string")
    assert list(one.select(*(classify.json_object(F.col(c)) for c in "abc")).first()) == ['{"a": [1]}', '{"b": 2}', None]
    assert spark.range(1).select(classify.program_type(F.lit("OrderServiceImpl"), F.lit("x"))).first()[0] == "serviceImpl"
    assert spark.range(1).select(classify.simple_type(F.lit("Map<K, List<V>>"))).first()[0] == "Map"
