"""Prefixes, range joins, methods, builders, blocks, lineage, specs and stores against brute force and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lineloom.operators import blocks, builders, discover, lineage, methods, prefix, reconcile, specs
from lineloom.sources import files, javaparse, store


@pytest.mark.parametrize("width", [3, 128])
def test_prefixes_equal_brute_force(spark, width):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.randrange(5), r.choice([None, None, f"v{i}"])) for i in range(60)]
    d = spark.createDataFrame(rows, "k string, at int, n int, v string")
    sums = prefix.running_sum(d, ["k"], "at", F.col("n"), "s", width)
    got = {x.at: x for x in prefix.as_of(sums, ["k"], "at", F.col("v"), "last", width=width).collect()}
    after = {x.at: x.next for x in prefix.as_of(d, ["k"], "at", F.col("v"), "next", True, width).collect()}
    assert len(got) == len(after) == len(rows)
    for k, at, _, _ in rows:
        before, later = [x for x in rows if x[0] == k and x[1] < at], [x for x in rows if x[0] == k and x[1] > at]
        assert (got[at].s, got[at].last) == (sum(x[2] for x in before), next((x[3] for x in reversed(before) if x[3]), None))
        assert after[at] == next((x[3] for x in later if x[3]), None)
    assert prefix.running_sum(d.limit(0), ["k"], "at", F.col("n")).count() == 0


def test_no_task_holds_a_group(spark):
    """A group of 20,000 rows is dealt to all tasks by (group, chunk), not to one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("at"), F.lit(1).alias("n"))
        out = prefix.running_sum(d, ["k"], "at", F.col("n"), last=20_000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4
        assert out.where("before <> at").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("size", [1, 7, 64])
def test_range_join_equals_brute_force(spark, size):
    r = random.Random(size)
    span = lambda: (lambda a: (a, a + r.choice([-1, 0, 3, 90])))(r.randrange(200))
    left, right = [(r.choice("ab"), i, *span()) for i in range(40)], [(r.choice("ab"), i, *span()) for i in range(40)]
    got = prefix.meet_ranges(spark.createDataFrame(left, "path string, i int, a int, b int"), spark.createDataFrame([*right, ("a", 99, None, 5)], "path string, j int, c int, d int"), "path", ("a", "b"), ("c", "d"), size)
    want = {(x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]}
    assert sorted((x.i, x.j) for x in got.collect()) == sorted(want)
    lines = [(r.choice("abc"), r.randrange(220)) for _ in range(60)]
    named = [(k, a, b, f"m{j}") for k, j, a, b in right]
    found = prefix.enclosing(spark.createDataFrame(lines, "path string, line int"), spark.createDataFrame(named, "path string, start_line int, end_line int, name string"), size=size)
    assert {(x.path, x.line): x.name for x in found.collect()} == {(k, n): min(((a, b, m) for p, a, b, m in named if p == k and a <= n <= b), default=(None,) * 3)[2] for k, n in lines}


JAVA = r"""package a;
class A {
  private Runnable r = new Runnable() {
    public void run() { go("}"); }
  };
  public A() { }
  /* public void gone() { */
  @Get("{x}") public static
  int notHere = 1;
  public int one() { return 1; }
  abstract void two(int a);
  protected <T> List<T> three(
      int a, String b) {
    char c = '{'; // }
    if (a > 1) { while (x) { y(); }
    }
  } public void four() {
    new Object() {
      public void inner() { }
    };
  }
  static class B {
    public void one() {
    }
  }
}"""


def test_method_ranges(spark):
    got = methods.ranges(spark.createDataFrame([("A.java", JAVA), ("null", None), ("empty", ""), ("open", "public void x() {")], "path string, text string")).collect()
    assert sorted((x.start_line, x.end_line, x.name, x.nth) for x in got) == [(4, 4, "run", 1), (10, 10, "one", 1), (11, 11, "two", 1), (12, 17, "three", 1), (17, 21, "four", 1), (23, 24, "one", 2)]
    same = spark.createDataFrame([("A.java", JAVA)], "path string, text string")
    assert {x.status for x in methods.changes(same, same).collect()} == {"same"}
    moved = methods.changes(same, same.withColumn("path", F.lit("B.java"))).collect()
    assert {(x.path, x.status, x.other_path) for x in moved} == {("A.java", "moved", "B.java"), ("B.java", "moved", "A.java")} and len(moved) == 12
    assert methods.changes(same.limit(0), same.limit(0)).count() == 0


def test_builders_meet_their_declaration(spark):
    text = 'class A { void a() { StringBuilder sql = new StringBuilder(); sql.append("x"); }\nvoid b() { sql.append("lost"); StringBuilder SQL1 = new StringBuilder(); sql1.append("a\\\\\\"b") .append(c).append(\'d\'); sql1.toString(); } }'
    d = spark.createDataFrame([("A.java", text), ("n", None), ("e", "")], "path string, text string")
    known = javaparse.types(d)
    got = builders.statements(d, javaparse.methods(known), known).collect()
    assert [(x.method, x.line, x.sql, x.query_type) for x in got] == [("b", 2, 'a\\"b', "SELECT")]


def brute_states(lines):
    """Whether each line begins in a block comment, letter by letter."""
    out, inside = [], False
    for t in lines:
        out.append(inside)
        i = 0
        while i < len(t):
            if inside:
                if t.startswith("*/", i):
                    inside, i = False, i + 1
            elif t.startswith("//", i):
                break
            elif t.startswith("/*", i):
                inside, i = True, i + 1
            elif t[i] in "\"'":
                j = i + 1
                while j < len(t) and t[j] != t[i]:
                    j += 2 if t[j] == "\\" else 1
                if j < len(t):
                    i = j
            i += 1
    return out


def test_comment_states_equal_brute_force(spark):
    r = random.Random(3)
    bits = ["/*", "*/", "//", '"', "'", "\\", "a", " ", "/", "*"]
    texts = {f"f{i}": ["".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(r.choice([1, 40, 300]))] for i in range(12)}
    d = spark.createDataFrame([(p, i, t) for p, ls in texts.items() for i, t in enumerate(ls)], "path string, line int, text string")
    got = {(x.path, x.line): x.in_comment for x in blocks.comment_states(d, ["path"]).collect()}
    assert got == {(p, i): s for p, ls in texts.items() for i, s in enumerate(brute_states(ls))}


def test_change_blocks(spark):
    text = [("int a;", 1), ("", 1), ("b();", 1), ("/* x", 0), ("", 0), ("*/", 0), ("}", 1), ("c();", 0), ("// one", 1), ("", 0), ("// two", 1), ("/** three */", 1), ("public void m() {", 0), (None, 1), ("d();", 1)]
    d = spark.createDataFrame([("f", i + 1, t, bool(c)) for i, (t, c) in enumerate(text)] + [("g", 1, "x", None), ("h", 1, "y", True)], "path string, line int, text string, changed boolean")
    got = sorted((x.path, x.start_line, x.end_line, x.pieces, x.style, x.title) for x in blocks.change_blocks(d).collect())
    assert got == [("f", 1, 2, 1, None, None), ("f", 3, 7, 2, None, None), ("f", 9, 12, 2, "line", None), ("f", 15, 15, 1, None, "public void m() {"), ("h", 1, 1, 1, None, None)]
    assert blocks.change_blocks(d.limit(0)).count() == 0


def test_report_keeps_every_row(spark):
    access = spark.createDataFrame([("T", "a.q", 1, None, [], [["C.x"]], "m", 2), ("T", "b.q", 2, "s/M.xml", [], None, "", 0), (None, "q", 3, None, None, None, None, None), ("T", None, 4, None, [], [], None, None)], "table_name string, sql_id string, ord int, source_path string, access_files array<string>, stacks array<array<string>>, result_map string, n_fields int")
    analysed = spark.createDataFrame([("T", "q", 5, "VO", "V", "MAP", "V", "s"), ("T", "b.q", 9, None, None, None, None, "own"), ("T", "z", 1, None, None, None, None, "left"), (None, "q", 1, None, None, None, None, "x")], "table_name string, query_id string, ord int, in_category string, in_class string, out_category string, out_class string, summary string")
    flows = spark.createDataFrame([("T", "c.q", 1, 7), ("U", "y", 1, None)], "table_name string, query_id string, ord int, flow_id int")
    told = spark.createDataFrame([("T", 7, None, 1, "F.java", "m", "EDIT"), ("U", None, "y", 1, "G.java", "n", None)], "table_name string, flow_id int, query_id string, ord int, file_name string, method string, action string")
    got = {(x.table_name, x.sql_id, x.found): (x.mapper, x.result_map, x.end_point, x.class_name, x.model, x.summary) for x in reconcile.report(access, analysed, flows, told).collect()}
    assert got == {
        ("T", "a.q", "both"): ("C.x", "○", "C.x", "F", "V", "s"), ("T", "b.q", "both"): ("C.x", "○", "C.x", "F", "", "own"), (None, "q", "neither"): (None, None, None, None, "", None), ("T", None, "neither"): (None, None, None, None, "", None),
        ("T", "z", "only analysed"): (None, None, None, None, "", "left"), ("U", "y", "only planned"): (None, None, None, "G", "", None), (None, "q", "only analysed"): (None, None, None, None, "", "x"),
    }
    assert reconcile.report(access.limit(0), analysed.limit(0), flows.limit(0), told.limit(0)).count() == 0


def test_ordered_lists(spark):
    d = spark.createDataFrame([("a", "x", 3), ("a", " y ", 1), ("a", "x", 0), ("a", None, 2), ("a", " ", 4), (None, "z", 1)], "k string, v string, at int")
    assert {tuple(r) for r in reconcile.ordered_distinct(d, ["k"], "v", "at", "l").collect()} == {("a", "x, y"), (None, "z")}
    assert {tuple(r) for r in reconcile.first_rows(d, ["k"], "at").collect()} == {("a", "x", 0), (None, "z", 1)}


def test_batch_rules(spark):
    queries = spark.createDataFrame([("b/Job_SQL.xml",), ("b/None_SQL.xml",), ("b/Job_SQL.xml",), (None,)], "path string")
    java = spark.createDataFrame([("b/JOB.java", "setQueryPath(\n  d + \"job_sql.XML\")"), ("c/My.java", 'setQueryPath("MyJob_SQL.xml")'), ("b/x.java", None)], "path string, text string")
    configs = spark.createDataFrame([("a_CFG.xml", "<s query-file='x\\job_sql.xml' class=\"p.J\"/><s class='' query-file='Job_SQL.xml'/>"), ("a.xml", '<s query-file="None_SQL.xml" class="J"/>'), ("b_cfg.xml", None)], "path string, text string")
    types = spark.createDataFrame([("J", "p.J", "p/J.java")], "class_name string, full_name string, path string")
    got = {(x.path, x.file, x.rules) for x in discover.batch_sources(queries, java, configs, types).collect()}
    assert got == {("b/Job_SQL.xml", "b/JOB.java", "query path, name"), ("b/Job_SQL.xml", "p/J.java", "config"), ("b/None_SQL.xml", None, None)}


def test_lineage(spark):
    rows = [("1", "SELECT x.* FROM (SELECT a.B AS C, F(a.D, (1+2)) E FROM S.A a) x, Y y"), ("2", "select c, t.d from t, u"), ("3", None), ("4", ""), ("5", "DELETE FROM (x"), ("6", "SELECT (SELECT MAX(z.Q) FROM Z z) AS M FROM A")]
    got = {tuple(r) for r in lineage.columns(spark.createDataFrame(rows, "sql_id string, sql string")).collect()}
    assert got == {("1", "C", "A", "B"), ("1", "E", "A", "D"), ("2", "C", None, "C"), ("2", "D", "T", "D")}


def test_specs(spark):
    text = '/** A\n * @author me */\npublic class A {\n  /** Runs.\n TITLE: Run */ @X(")") private void run(int a) { }\n  // no\n  public void other() { }\n}'
    d = spark.createDataFrame([("a", text), ("n", None), ("e", ""), ("c", "class B { }")], "path string, text string")
    found = specs.declarations(d)
    assert {(x.path, x.name, x.style) for x in found.collect()} == {("a", "A", "javadoc"), ("a", "run", "javadoc"), ("a", "other", None), ("c", "B", None)}
    fields = {(x.line, x.field, x.value) for x in specs.comment_fields(found).collect()}
    assert fields == {(0, "body", "A"), (1, "author", "me"), (1, "body", "@author me"), (0, "body", "Runs."), (1, "title", "Run")}


def test_quarantine(spark, tmp_path):
    at = tmp_path / "in" / "20240101" / "T" / "C"
    at.mkdir(parents=True)
    (at / "step1.json").write_text('{"a": 1}\n{"a": "x"}\n\n{"b": 2}\n{"a": 3')
    (tmp_path / "in" / "20240102" / "U" / "D").mkdir(parents=True)
    (tmp_path / "in" / "20240102" / "U" / "D" / "step1.json").write_text("")
    good, bad = store.quarantined(spark, str(tmp_path / "in"), "a long", str(tmp_path / "out"))
    assert sorted(map(repr, (tuple(r) for r in good.collect()))) == sorted(map(repr, [(1, "20240101", "T", "C"), (None, "20240101", "T", "C")]))
    assert sorted((r.record, r.table_name) for r in bad.collect()) == [('{"a": "x"}', "T"), ('{"a": 3', "T")]


def test_failed_report_leaves_the_last_version(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "section string, v long"
    first = spark.createDataFrame([("a/b", 2), ("a/b", 1), (None, 3), ("", 4)], schema)
    store.write_report(first, path, "section", ["v"])
    broken = first.repartition(2).withColumn("v", F.when(F.col("v") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.write_report(broken, path, "section", ["section"])
    assert sorted(map(repr, (tuple(r) for r in store.read_report(spark, path, schema).collect()))) == sorted(map(repr, [("a/b", 1), ("a/b", 2), (None, 3), ("", 4)]))
    store.write_report(first.limit(0), path, "section", ["v"])
    assert store.read_report(spark, path, schema).count() == 0 and store.clear_versions(spark, path) == 1
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith(".") and p.is_dir()]


def test_versions_of_a_table(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1,), (2,)], "a int")
    assert files.versions(spark, path) == [] and files.load(spark, path, "a int").count() == 0 and files.version_info(spark, path).count() == 0
    first = files.save(df, path)
    files.save(df.limit(1), path)
    with pytest.raises(Exception, match="no"):
        files.save(df.withColumn("a", F.raise_error(F.lit("no")).cast("int")), path)
    assert len(files.versions(spark, path)) == 2 and files.load(spark, path, "a int").count() == 1 and files.load(spark, path, "a int", first).count() == 2
    assert files.version_info(spark, path).count() == 2


def test_endpoint_access_equals_brute_force(spark):
    import re

    from lineloom.operators import access

    r = random.Random(6)
    bit = lambda: r.choice(["a", "b", "ab", "api", "list", "7", "42", "x.y", ""])
    paths = [r.choice(["", "/"]) + "/".join(bit() for _ in range(r.randrange(1, 5))) for _ in range(120)]
    counts = [(p, r.randrange(4), i) for i, p in enumerate(paths)]
    spot = lambda: r.choice(["{id}", "{n}", "v{id}", "api{id}x", "list"]) if r.random() < 0.5 else bit()
    ends = {r.choice(["", "/"]) + "/".join(spot() for _ in range(r.randrange(1, 5))) for _ in range(150)} | {"", " ", "{x}", "/{x}", "/{x}/{y}", "b", "/ab", "i/list", None}

    def want(e):
        if e is None or not e.strip():
            return 0
        if "{" in e:
            p = ".+".join(re.escape(x) for x in re.split(r"\{[^}]+\}", e))
            whole = sum(c for q, c, _ in counts if re.fullmatch(p, q))
            return whole if whole > 0 else sum(c for q, c, _ in counts if re.search(p, q))
        same = [c for q, c, _ in counts if q == e] or [c for q, c, _ in counts if q.endswith(e)]
        return same[0] if same else 0

    got = access.endpoint_access(spark.createDataFrame([(e,) for e in ends], "end_point string"), spark.createDataFrame(counts, "path string, access_cnt long, ord int"))
    assert {x.end_point: x.access_cnt for x in got.collect()} == {e: want(e) for e in ends}
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_brute_force(spark, seed):
    from lineloom.operators import batching

    r = random.Random(seed)
    prompt, separator, budget = r.choice([(0, 1, 50), (10, 2, 40), (5, 0, 30)])
    rows = [(g, i, r.choice([0, 1, 5, 20, 60, None, 33])) for g in ("a", "b", None) for i in r.sample(range(200), r.choice([1, 40, 90]))]
    d = spark.createDataFrame(rows, "g string, o int, t int")
    batches, chosen = {}, set()
    for g in {x[0] for x in rows}:
        batch, used, left = 0, None, budget
        for _, o, t in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            t = t or 0
            if used is not None and used + t + separator > budget:
                batch, used = batch + 1, prompt + t
            else:
                used = prompt + t if used is None else used + t + separator
            batches[g, o] = batch
            if t <= left:
                left -= t
                chosen.add((g, o))
    assert {(x.g, x.o): x.batch for x in batching.greedy_batches(d, "g", "o", "t", prompt, separator, budget).collect()} == batches
    assert {(x.g, x.o) for x in batching.budget_select(d, "g", "o", "t", budget).collect()} == chosen


def test_empty_batches(spark):
    from lineloom.operators import batching

    none = spark.createDataFrame([], "g string, o int, t int")
    assert batching.greedy_batches(none, "g", "o", "t", 0, 1, 9).count() == batching.budget_select(none, "g", "o", "t", 9).count() == 0
