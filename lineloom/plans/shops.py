"""Registered queries over projects that are made of the given tables: a shop for each supplier, statements for each order.

The sources are texts made of a row's keys; the SQL twins never read them, but work out from the keys what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, javatext, sqltext
from ..operators import access as acc
from ..operators import graph, matching, patching, reports, resolve
from ..sources import batchsql, javaparse
from .catalog import query, spread, table

# --- statements of orders ---------------------------------------------------------------------------------------------

_C, _O = "concat('cust', o_orderkey % 7)", "concat('ord', o_orderkey % 3)"
_STATEMENTS = f"""select concat('s', o_orderkey) as sql_id, concat('f', o_orderkey % 11, case when o_orderkey % 2 = 0 then 'Mapper.xml' else 'Dao.java' end) as file, case o_orderkey % 8
  when 0 then concat('SELECT c_name, c_acctbal FROM ', {_C}, ' WHERE c_custkey = #{{id}}') when 1 then concat('SELECT * FROM ', {_C})
  when 2 then concat('SELECT c.c_name, o.o_totalprice AS price FROM ', {_C}, ' c INNER JOIN ', {_O}, ' o ON c.c_custkey = o.o_custkey')
  when 3 then concat('select o.o_orderkey, c.c_name nm from sales.', {_O}, ' o left join sales.', {_C}, ' c on o.o_custkey = c.c_custkey where o.st = #{{status}}')
  when 4 then concat('INSERT INTO ', {_O}, ' (o_orderkey, o_totalprice) VALUES (#{{key}}, #{{price}})') when 5 then concat('UPDATE ', {_C}, ' SET c_name = #{{name}}, c_acctbal = $', '{{bal}} WHERE c_custkey = #{{id}}')
  when 6 then concat('DELETE FROM ', {_O}, ' WHERE o_orderkey = #{{key}}') else '/* names */ SELECT p_name -- only\n FROM part' end as sql from {{orders}}"""
_WATCHED = """select case when n_nationkey < 7 or n_nationkey = 11 then concat('cust', n_nationkey % 8) when n_nationkey < 10 then concat('ord', n_nationkey - 7) else 'part' end as table_name,
  case when n_nationkey < 7 then 'c_name' when n_nationkey < 10 then 'o_totalprice' when n_nationkey = 10 then 'p_name' else 'c_custkey' end as column_name, n_nationkey in (8, 10) as new_column from {nation} where n_nationkey < 12"""
_LAYERS = "select distinct concat('f', o_orderkey % 11, case when o_orderkey % 2 = 0 then 'Mapper.xml' else 'Dao.java' end) as file, case when o_orderkey % 2 = 0 then 'mapper' else 'dao' end as layer, cast(o_orderkey % 22 as int) as ord from {orders}"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).selectExpr(*_columns(_STATEMENTS))


def _columns(text: str) -> list[str]:
    """The select list of one of the texts above, so that braces in them need no care."""
    inside = text[len("select ") : text.rindex(" from {")]
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(inside):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(inside[start:i])
            start = i + 1
    return [*out, inside[start:]]


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_WATCHED, nation=table(spark, sf_dir, "nation"))


_K = "(select concat('s', o_orderkey) as sql_id, o_orderkey % 8 as m, concat('CUST', o_orderkey % 7) as c, concat('ORD', o_orderkey % 3) as o, concat('f', o_orderkey % 11, case when o_orderkey % 2 = 0 then 'Mapper.xml' else 'Dao.java' end) as file from orders)"
_REFS = f"select sql_id, c as table_name from {_K} where m in (0, 1, 2, 3, 5) union all select sql_id, o from {_K} where m in (2, 3, 4, 6) union all select sql_id, 'PART' from {_K} where m = 7"
_USED = f"""select sql_id, c as table_name, 'C_NAME' as column_name from {_K} where m in (0, 2, 3, 5) union all select sql_id, c, 'C_ACCTBAL' from {_K} where m in (0, 5) union all select sql_id, o, 'O_TOTALPRICE' from {_K} where m in (2, 4)
  union all select sql_id, o, 'O_ORDERKEY' from {_K} where m in (3, 4) union all select sql_id, 'PART', 'P_NAME' from {_K} where m = 7"""
_JOINS = f"select sql_id, 'INNER' as join_type, c as left_table, 'C_CUSTKEY' as left_column, o as right_table, 'O_CUSTKEY' as right_column from {_K} where m = 2 union all select sql_id, 'LEFT', o, 'O_CUSTKEY', c, 'C_CUSTKEY' from {_K} where m = 3"
_FOUND = f"""select sql_id, file, c as table_name from {_K} where m in (0, 1, 2, 3, 5) union all select sql_id, file, o from {_K} where m in (2, 4) or m in (3, 6) and o = 'ORD1' union all select sql_id, file, 'PART' from {_K} where m = 7"""


@query(_REFS)
def sql_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("sql_id", F.explode(sqltext.table_names(F.col("sql"))).alias("table_name"))


@query(_USED)
def sql_column_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = statements(spark, sf_dir).withColumn("table_name", F.explode(sqltext.table_names(F.col("sql"))))
    return refs.select("sql_id", "table_name", F.explode(sqltext.column_names(F.col("sql"), F.col("table_name"))).alias("column_name"))


@query(
    f"""select sql_id, case when m in (0, 1, 2, 3, 7) then 'SELECT' when m = 4 then 'INSERT' when m = 5 then 'UPDATE' else 'DELETE' end as query_type,
    case m when 0 then 'id' when 3 then 'status' when 4 then 'key,price' when 5 then 'bal,id,name' when 6 then 'key' else '' end as params from {_K}"""
)
def sql_query_type_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.col("sql")
    return statements(spark, sf_dir).select("sql_id", sqltext.query_type(sql).alias("query_type"), F.array_join(sqltext.parameters(sql), ",").alias("params"))


@query(_JOINS)
def sql_join_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqltext.join_edges(statements(spark, sf_dir))


@query(f"with e as ({_JOINS}) select distinct right_table, right_column from e where right_table <> 'CUST3'")
def unknown_join_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join columns that no watched column is."""
    joined = sqltext.join_edges(statements(spark, sf_dir)).select(F.concat_ws(".", "right_table", "right_column").alias("key"))
    known = watched(spark, sf_dir).select(F.upper(F.concat_ws(".", "table_name", "column_name")).alias("key"))
    parts = F.split("key", r"\.")
    return acc.missing(joined, known, "key").select(parts[0].alias("right_table"), parts[1].alias("right_column"))


@query(
    f"""select sql_id, 'c_name' as "column", null as alias from {_K} where m in (0, 2) union all select sql_id, 'c_acctbal', null from {_K} where m = 0 union all select sql_id, null, null from {_K} where m = 1 union all select sql_id, 'o_totalprice', 'price' from {_K} where m = 2
    union all select sql_id, 'o_orderkey', null from {_K} where m = 3 union all select sql_id, 'c_name', 'nm' from {_K} where m = 3 union all select sql_id, 'p_name', null from {_K} where m = 7"""
)
def sql_select_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("sql_id", F.explode(sqltext.select_items(F.col("sql"))).alias("i")).select("sql_id", "i.column", "i.alias")


@query(
    f"""select sql_id, 'C_NAME' as c, case when m = 3 then 'nm' else 'C_NAME' end as alias from {_K} where m in (0, 2, 3) union all select sql_id, 'O_TOTALPRICE', 'price' from {_K} where m = 2"""
)
def sql_select_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.array(F.lit("C_NAME"), F.lit("O_TOTALPRICE"))
    return statements(spark, sf_dir).select("sql_id", F.explode(sqltext.columns_by_alias(F.col("sql"), targets)).alias("i")).select("sql_id", F.col("i.column").alias("c"), "i.alias")


@query(_FOUND)
def sensitive_access_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.watched_access(statements(spark, sf_dir), watched(spark, sf_dir))


@query(
    f"""with a as ({_FOUND}), l as ({_LAYERS.replace("{orders}", "orders")}), n as (select table_name, layer, count(distinct file) as c, min(ord) as o from a join l using (file) group by 1, 2)
    select table_name, count(distinct sql_id) as n_statements, string_agg(distinct sql_id, ',' order by sql_id) as statements, string_agg(distinct file, ',' order by file) as files,
      (select layer from n where n.table_name = a.table_name order by c desc, o limit 1) as main_layer from a group by table_name"""
)
def table_access_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir)
    layers = spark.sql(_LAYERS, orders=table(spark, sf_dir, "orders"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return acc.table_rollup(acc.watched_access(s, watched(spark, sf_dir)).join(layers, "file"), s).select("table_name", "n_statements", joined("statements"), joined("files"), "main_layer")


@query(f"select file as path, concat('a.B.', sql_id) as signature, case m when 0 then 'id' when 3 then 'status' when 4 then 'key,price' when 5 then 'bal,id,name' when 6 then 'key' else '' end as parameters from {_K} where m <> 1 union all select file, sql_id, '' from {_K} where m = 1")
def statement_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir).select(F.col("file").alias("path"), F.when(F.col("sql").rlike(r"^SELECT \*"), "").otherwise("a.B").alias("namespace"), "sql_id", "sql")
    return reports.statement_signatures(s).withColumn("parameters", F.array_join("parameters", ","))


# --- shops of suppliers -----------------------------------------------------------------------------------------------

_V = "concat('V', s_suppkey % 5)"
_FILES = {
    "web": ("concat('p', s_suppkey, '/web/C', s_suppkey, '.java')", rf"""concat('package shop.web;\nimport shop.svc.S', s_suppkey, ';\n@RestController\n@RequestMapping("/c', s_suppkey, '/")\npublic class C', s_suppkey, ' extends Base {{\n  private final S', s_suppkey, ' svc; // svc.fake();\n  @GetMapping("/find/{{id}}")\n  public ',
      {_V}, ' find(Long id) {{ log("/* find( */"); return svc.load(id); }}\n  @PostMapping(value = "add")\n  public void add(', {_V}, ' v, Pageable page) {{\n    ', case when s_suppkey % 2 = 1 then 'Checker<V> c = new Checker<>(); if (c.valid(v)) {{ check(v); }}' else 'check(v);' end,
      '\n    this.svc.save(v);\n  }}\n  private void check(', {_V}, ' v) {{ }}\n}}\n')"""),
    "svc": ("concat('p', s_suppkey, '/svc/S', s_suppkey, '.java')", rf"concat('package shop.svc;\npublic interface S', s_suppkey, ' {{\n  ', {_V}, ' load(Long id);\n  void save(', {_V}, ' v);\n}}\n')"),
    "impl": ("concat('p', s_suppkey, '/svc/S', s_suppkey, 'Impl.java')", rf"""concat('package shop.svc;\nimport shop.db.M', s_suppkey, ';\n@Service\npublic class S', s_suppkey, 'Impl ', case when s_suppkey % 3 = 0 then 'extends BaseService ' else '' end, 'implements shop.svc.S', s_suppkey, ' {{\n  @Autowired private M', s_suppkey, ' mapper;\n  public ',
      {_V}, ' load(Long id) {{ return mapper.select(id); }}\n  public void save(', {_V}, ' v) {{ mapper.insert(v); ', case when s_suppkey % 4 = 0 then 'retry(v); ' else '' end, '}}\n  void retry(', {_V}, ' v) {{ save(v); }}\n}}\n')"""),
    "db": ("concat('p', s_suppkey, '/db/M', s_suppkey, '.java')", rf"concat('package shop.db;\n@Mapper\npublic interface M', s_suppkey, ' {{\n  ', {_V}, ' select(Long id);\n  int insert(', {_V}, ' v);\n  List<', {_V}, '> all();\n}}\n')"),
}
#: Keys of a supplier's shop in the twins.
_S = "(select s_suppkey as k, concat('C', s_suppkey) as c, concat('S', s_suppkey) as s, concat('S', s_suppkey, 'Impl') as i, concat('M', s_suppkey) as m, concat('V', s_suppkey % 5) as v, concat('p', s_suppkey, '/') as p from supplier)"


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of four files for each supplier."""
    supplier, out = spread(table(spark, sf_dir, "supplier").select("s_suppkey")), None
    for path, text in _FILES.values():
        one = supplier.select(F.expr(path).alias("path"), F.expr(text.replace("{{", "{").replace("}}", "}")).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def types_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return javaparse.types(shops(spark, sf_dir))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = types_of(spark, sf_dir)
    return resolve.expand_interfaces(resolve.call_edges(t, javaparse.methods(t)), t)


@query(
    f"""select p || 'web/' || c || '.java' as path, c as class_name, 'class' as kind, 'Base' as superclass, '' as interfaces from {_S} union all select p || 'svc/' || s || '.java', s, 'interface', '', '' from {_S}
    union all select p || 'svc/' || i || '.java', i, 'class', case when k % 3 = 0 then 'BaseService' else '' end, 'shop.svc.' || s from {_S} union all select p || 'db/' || m || '.java', m, 'interface', '', '' from {_S}"""
)
def java_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types_of(spark, sf_dir).select("path", "class_name", "kind", F.coalesce("superclass", F.lit("")).alias("superclass"), F.array_join("interfaces", ",").alias("interfaces"))


_METHODS = f"""select c as class_name, 'find' as name, v as return_type, 'Long id' as params, 'log svc.load' as calls, 7 as start_line, 8 as end_line, p || 'web/' || c || '.java' as path from {_S}
  union all select c, 'add', 'void', v || ' v,Pageable page', case when k % 2 = 1 then 'c.valid check svc.save' else 'check svc.save' end, 9, 13, p || 'web/' || c || '.java' from {_S} union all select c, 'check', 'void', v || ' v', '', 14, 14, p || 'web/' || c || '.java' from {_S}
  union all select s, 'load', v, 'Long id', '', 3, 3, p || 'svc/' || s || '.java' from {_S} union all select s, 'save', 'void', v || ' v', '', 4, 4, p || 'svc/' || s || '.java' from {_S}
  union all select i, 'load', v, 'Long id', 'mapper.select', 6, 6, p || 'svc/' || i || '.java' from {_S} union all select i, 'save', 'void', v || ' v', case when k % 4 = 0 then 'mapper.insert retry' else 'mapper.insert' end, 7, 7, p || 'svc/' || i || '.java' from {_S}
  union all select i, 'retry', 'void', v || ' v', 'save', 8, 8, p || 'svc/' || i || '.java' from {_S} union all select m, 'select', v, 'Long id', '', 4, 4, p || 'db/' || m || '.java' from {_S}
  union all select m, 'insert', 'int', v || ' v', '', 5, 5, p || 'db/' || m || '.java' from {_S} union all select m, 'all', 'List<' || v || '>', '', '', 6, 6, p || 'db/' || m || '.java' from {_S}"""


@query(f"select class_name, name, return_type, params, calls, start_line, end_line from ({_METHODS})")
def java_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ",")
    return javaparse.methods(types_of(spark, sf_dir)).select("class_name", "name", "return_type", params.alias("params"), F.array_join("calls", " ").alias("calls"), "start_line", "end_line")


_DIRECT = f"""select c || '.find' as caller, c || '.log' as callee, p || 'web/' || c || '.java' as callee_file from {_S} union all select c || '.find', s || '.load', p || 'svc/' || s || '.java' from {_S} union all select c || '.add', 'Checker.valid', p || 'web/' || c || '.java' from {_S} where k % 2 = 1
  union all select c || '.add', c || '.check', p || 'web/' || c || '.java' from {_S} union all select c || '.add', s || '.save', p || 'svc/' || s || '.java' from {_S} union all select i || '.load', m || '.select', p || 'db/' || m || '.java' from {_S}
  union all select i || '.save', m || '.insert', p || 'db/' || m || '.java' from {_S} union all select i || '.save', i || '.retry', p || 'svc/' || i || '.java' from {_S} where k % 4 = 0 union all select i || '.retry', i || '.save', p || 'svc/' || i || '.java' from {_S}"""
_ALL = f"{_DIRECT} union all select c || '.find', i || '.load', p || 'svc/' || i || '.java' from {_S} union all select c || '.add', i || '.save', p || 'svc/' || i || '.java' from {_S}"


@query(_DIRECT)
def java_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = types_of(spark, sf_dir)
    return resolve.call_edges(t, javaparse.methods(t)).select("caller", "callee", "callee_file")


@query(_ALL)
def java_interface_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).select("caller", "callee", "callee_file")


@query(f"select c as class_name, 'Controller' as layer from {_S} union all select s, 'Unknown' from {_S} union all select i, 'Service' from {_S} union all select m, 'Mapper' from {_S}")
def layer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.transform(c, lambda x: x["type"])
    return types_of(spark, sf_dir).select("class_name", classify.layer(F.col("class_name"), F.col("package"), F.col("annotations"), F.col("interfaces"), of("fields")).alias("layer"))


@query(f"select class_name, name, case when name = 'add' then 'paged_list' when name = 'all' then 'unpaged_list' else 'single' end as data_type from ({_METHODS})")
def data_type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return javaparse.methods(types_of(spark, sf_dir)).select("class_name", "name", classify.data_type(F.col("return_type"), F.col("params"), F.lit("SELECT 1")).alias("data_type"))


_TREE = f"""with recursive e as (select caller, callee from ({_ALL})), t as (
  select n as root, n as node, 0 as depth, [n] as path, false as is_circular from (select c || '.find' as n from {_S} union all select c || '.add' from {_S})
  union all select t.root, e.callee, t.depth + 1, list_append(t.path, e.callee), list_contains(t.path, e.callee) from t join e on e.caller = t.node where not t.is_circular and t.depth < 10)"""


def tree_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "supplier").select(F.explode(F.expr("array(concat('C', s_suppkey, '.find'), concat('C', s_suppkey, '.add'))")).alias("node"))
    return graph.call_tree(edges_of(spark, sf_dir), roots)


@query(f"{_TREE} select root, node, depth, array_to_string(path, '>') as path, is_circular from t")
def call_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_of(spark, sf_dir).select("root", "node", "depth", F.array_join("path", ">").alias("path"), "is_circular")


@query(f"{_TREE} select root, row_number() over (partition by root order by path) as place, repeat('  ', depth) || node || case when is_circular then ' (circular)' else '' end as line from t")
def call_tree_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.printed(tree_of(spark, sf_dir)).select("root", F.col("place").cast("long").alias("place"), "line")


@query(f"{_TREE} select root, array_to_string(path, '>') as path from t where not is_circular and ends_with(node, '.insert')")
def call_paths_to_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths_to(tree_of(spark, sf_dir), ".insert").select("root", F.array_join("path", ">").alias("path"))


@query(f"with e as (select caller, callee from ({_ALL})) select (select count(*) from (select caller from e union select callee from e)) as n_nodes, (select count(*) from (select distinct caller, callee from e)) as n_edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts(edges_of(spark, sf_dir))


@query(
    f"""with m as ({_METHODS}), k as (select path, class_name, name, regexp_extract(unnest(string_split(calls, ' ')), '[^.]*$') as callee from m where calls <> ''), f as (select name, max(path) as path from m group by name)
    select distinct concat(k.class_name, '.', k.name) as caller, concat(k.class_name, '.', callee) as callee, k.path as caller_file, coalesce(f.path, k.path) as callee_file from k left join f on f.name = callee"""
)
def calls_of_own_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.local_calls(javaparse.methods(types_of(spark, sf_dir)))


@query(
    f"""select 'm/' || k || '.xml' as path, id as sql_id, m || '.' || id as method, layer, file from (
      select k, m, 'select' as id, 'mapper' as layer, p || 'db/' || m || '.java' as file from {_S} union all select k, m, 'select', 'mapper', p || 'svc/' || s || '.java' from {_S} union all select k, m, 'select', 'xml', 'm/' || k || '.xml' from {_S}
      union all select k, m, 'insert', 'mapper', p || 'db/' || m || '.java' from {_S} union all select k, m, 'insert', 'mapper', p || 'svc/' || i || '.java' from {_S} union all select k, m, 'insert', 'xml', 'm/' || k || '.xml' from {_S})"""
)
def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = """inline(array(struct('select' as sql_id, 'java.lang.Long' as parameter_type, concat('S', s_suppkey) as result_type, cast(null as string) as result_map),
      struct('insert' as sql_id, concat('other.S', s_suppkey, 'Impl') as parameter_type, cast(null as string) as result_type, 'aMap' as result_map)))"""
    s = table(spark, sf_dir, "supplier").selectExpr("concat('m/', s_suppkey, '.xml') as path", "concat('shop.db.M', s_suppkey) as namespace", made)
    return resolve.statement_files(s, types_of(spark, sf_dir)).drop("namespace")


@query(
    f"""select p || 'web/' || c || '.java' as controller, p || 'svc/' || s || '.java,' || p || 'svc/' || i || '.java,' || p || 'web/' || c || '.java' as files, p || 'db/' || m || '.java' as context from {_S}"""
)
def controller_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    paths = lambda *x: supplier.select(F.explode(F.array(*(F.expr(_FILES[n][0]) for n in x))).alias("path"))
    got = resolve.controller_groups(types_of(spark, sf_dir), paths("web"), paths("svc", "impl"), paths("db"))
    return got.select("controller", F.array_join("files", ",").alias("files"), F.array_join("context", ",").alias("context"))


@query(
    f"""select p || 'web/' || c || '.java' as path, 'find' as method, 'Long' as in_type, v as out_type from {_S} union all select p || 'db/' || m || '.java', 'all', 'void', 'List<' || v || '>' from {_S}
    union all select p || 'db/' || m || '.java', 'gone', null, null from {_S} where k % 2 = 0 union all select 'txt/' || k, 'call', 'Map<K', 'List<X>' from {_S}"""
)
def method_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    texts = supplier.selectExpr("concat('txt/', s_suppkey) as path", "'List<X> call( Map<K,V> m, int n) ...' as text")
    asked = supplier.select(F.explode(F.expr(f"array(struct({_FILES['web'][0]} as path, 'find' as method), struct({_FILES['db'][0]} as path, 'all' as method), struct(concat('txt/', s_suppkey) as path, 'call' as method))")).alias("a")).select("a.*")
    asked = asked.unionByName(supplier.where("s_suppkey % 2 = 0").selectExpr(f"{_FILES['db'][0]} as path", "'gone' as method"))
    sources = shops(spark, sf_dir)
    return reports.method_types(asked, javaparse.methods(javaparse.types(sources)), sources.unionByName(texts))


@query(f"select c as class_name, 'add' as name from {_S} where k % 2 = 1 union all select i, 'save' from {_S} where k % 4 = 0")
def calling_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shops(spark, sf_dir)
    return reports.calling_methods(javaparse.methods(javaparse.types(s)), s, ["Checker.valid(V)", "S.retry(V)", "noDot"]).select("class_name", "name")


@query(f"select p || 'web/' || c || '.java' as path, h as http_method, '/c' || k || e as end_point from {_S}, (values ('GET', '/'), ('GET', '/find/{{id}}'), ('POST', '/add')) as x(h, e)".replace("{{id}}", "{id}"))
def mapping_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return javatext.mapping_paths(shops(spark, sf_dir))


@query(
    f"""select k, n as id, case n when 1 then p || 'svc/' || s || '.java' when 2 then p || 'svc/' || s || '.java' when 3 then p || 'svc/' || i || '.java' when 4 then p || 'db/' || m || '.java' when 5 then p || 'web/' || c || '.java' end as file,
    case n when 1 then 'index' when 2 then 'exact' when 3 then 'case_insensitive' when 4 then 'signature' when 5 then 'index' else 'failed' end as way from {_S}, (values (1), (2), (3), (4), (5), (6)) as x(n)"""
)
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    order = {"web": 1, "svc": 2, "impl": 3, "db": 4}
    files = None
    for name, (path, text) in _FILES.items():
        one = supplier.select(F.expr("cast(s_suppkey as string)").alias("request"), F.lit(order[name]).alias("idx"), F.expr(path).alias("path"), F.expr(text.replace("{{", "{").replace("}}", "}")).alias("text"))
        files = one if files is None else files.unionByName(one)
    idents = """array('FILE_2', concat('x/y/S', s_suppkey, '.java'), concat('s', s_suppkey, 'IMPL.JAVA'), 'New.java', ' file_1.java ', '#')"""
    asked = supplier.select(F.expr("cast(s_suppkey as string)").alias("request"), F.posexplode(F.expr(idents)).alias("n", "ident"), F.expr("concat('package shop.db; interface M', s_suppkey, ' { }')").alias("sign"))
    asked = asked.select("request", (F.col("n") + 1).alias("id"), "ident", F.when(F.col("n") == 3, F.col("sign")).alias("code"))
    return matching.named_files(asked, files).select(F.col("request").cast("long").alias("k"), "id", "file", "way")


# --- other files of suppliers -----------------------------------------------------------------------------------------


@query("select 'b/J' || s_suppkey || '_SQL.xml' as path, x.id || s_suppkey as sql_id, x.t as query_type, x.a || s_suppkey || x.b as sql, x.q as is_query from supplier, (values ('q', 'SELECT', 'SELECT ', ' FROM tx', true), ('o', 'DELETE', 'delete from t', '', false)) as x(id, t, a, b, q) where s_suppkey % 5 > 0")
def batch_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""concat('<sql><query id="q', s_suppkey, '">SELECT ', s_suppkey, ' -- one\n <b>FROM</b> t<!-- gone -->x</query><query>no id</query><query id="e"> /* nothing */ </query><other id="o', s_suppkey, '">delete from t', s_suppkey, case when s_suppkey % 5 > 0 then '</other></sql>' else '' end)"""
    files = table(spark, sf_dir, "supplier").select(F.expr("concat('b/J', s_suppkey, '_SQL.xml')").alias("path"), F.expr(text).alias("text"))
    some, more = (batchsql.statements(files, any_element=x).drop("place") for x in (False, True))
    return some.withColumn("is_query", F.lit(True)).unionByName(more.exceptAll(some).withColumn("is_query", F.lit(False)))


@query("select 'ns.o' || s_suppkey as namespace, 'D' || s_suppkey as class_name, x.m as method, case when x.m = 'find' then 'f' || s_suppkey end as sql_id from supplier, (values ('find'), ('none')) as x(m)")
def namespace_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"""concat('package d;\nclass Other { void no() { } }\npublic class D', s_suppkey, ' {\n  private static final String NAMESPACE = "ns.o', s_suppkey, '.";\n  void find() { run(NAMESPACE + "f', s_suppkey, '"); }\n  // NAMESPACE + "gone"\n  void none() { run(', if(s_suppkey % 2 = 0, 'NAMESPACE', '1'), '); }\n}\n')"""
    sources = table(spark, sf_dir, "supplier").select(F.expr("concat('d/D', s_suppkey, '.java')").alias("path"), F.expr(text).alias("text"))
    return resolve.namespace_methods(sources, javaparse.methods(javaparse.types(sources))).drop("path")


_POINTS = r"""case s_suppkey % 3 when 0 then concat('@LocalName("svc/")\npublic class A', s_suppkey, ' {\n  @ServiceIdMapping("/tx', s_suppkey, '") @Trace\n  public Map<String, Object> one(Map in) { return null; }\n  // @ServiceIdMapping("no") void no() { }\n  @ServiceIdMapping(value = "v', s_suppkey, '")\n  void two() { }\n  public void three() { }\n}')
  when 1 then concat('class A', s_suppkey, 'Bat { void execute() { } void other() { } }') else concat('class A', s_suppkey, 'Tasklet { public void run() { } void execute() { } }') end"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.expr("concat('w/A', s_suppkey, case s_suppkey % 3 when 1 then 'Bat' when 2 then 'Tasklet' else '' end, '.java')").alias("path"), F.expr(_POINTS).alias("text"))


@query("select 'w/A' || s_suppkey || '.java' as path, 'A' || s_suppkey as class_name, x.m as method_name, 'svc/' || x.e || s_suppkey as end_point, 'ServiceIdMapping' as http_method from supplier, (values ('one', 'tx'), ('two', 'v')) as x(m, e) where s_suppkey % 3 = 0")
def service_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return javatext.service_endpoints(points(spark, sf_dir))


@query(
    """select 'w/A' || s_suppkey || 'Bat.java' as path, 'A' || s_suppkey || 'Bat.execute' as signature, null as http_method, 'w/A' || s_suppkey || 'Bat.java' as end_point from supplier where s_suppkey % 3 = 1
    union all select 'w/A' || s_suppkey || 'Tasklet.java', 'A' || s_suppkey || 'Tasklet.run', 'BATCH', 'A' || s_suppkey || 'Tasklet' from supplier where s_suppkey % 3 = 2"""
)
def batch_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.batch_endpoints(javaparse.methods(javaparse.types(points(spark, sf_dir))))


@query("select 'f' || c_custkey as name, cast(c_custkey % 3 as int) as dep0, 1 as dep1, case when c_custkey % 4 = 0 then 1 else 0 end as dep2, case when c_custkey % 4 = 0 then 2 else 1 end as max_loop_depth, cast(c_custkey % 3 + case when c_custkey % 4 = 0 then 2 else 1 end as int) as total_calls from customer")
def crypto_calls_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = r"""concat('void f() { /* CipherUtil.encrypt(a) */ log("CipherUtil.encrypt(b)"); // CipherUtil.encrypt(c)\n', repeat('CipherUtil.encrypt(z); ', cast(c_custkey % 3 as int)), 'for (A a : all) { CipherUtil . encrypt(a.x); CipherUtil.name(a); ',
      case when c_custkey % 4 = 0 then 'while (a.next()) { CipherUtil.decryptAll(a); } ' else '' end, '} }')"""
    rows = table(spark, sf_dir, "customer").select(F.expr("concat('f', c_custkey)").alias("name"), F.expr(code).alias("code"))
    names = ["com.shop.CipherUtil.encrypt(String) -> String", "CipherUtil.decryptAll", "CipherUtil.name"]
    return rows.select("name", reports.calls_by_depth(F.col("code"), names).alias("c")).select("name", "c.*")


# --- proposed changes -------------------------------------------------------------------------------------------------

_TEXT = r"concat('a', c_custkey, '\n// note\nb\nc\nd\n')"
_DIFF = r"concat('--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@ part ', c_custkey, '\n a', c_custkey, '\n-b\n+B', c_custkey, '\n c\n@@ -9 +9 @@\n-zz\n+y\n@@ -4,0 +5 @@\n+end\n')"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, change, way): a proposed change of a text for each customer, in one of four ways."""
    change = rf"case c_custkey % 4 when 0 then {_DIFF} when 1 then concat('<<< SEARCH\nb\nc\n===\nq', c_custkey, '\n>>> REPLACE\nno\n<<< SEARCH\nd\n===\nz\n>>> REPLACE') when 2 then concat('<<< SEARCH\nnone', c_custkey, '\n===\nq\n>>> REPLACE') else concat('new', c_custkey, '\n') end"
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_TEXT).alias("text"), F.expr(change).alias("change"), F.expr("case c_custkey % 4 when 0 then 'diff' when 3 then 'full' else 'part' end").alias("way"))


@query(
    r"""select c_custkey as id, case c_custkey % 4 when 0 then concat('a', c_custkey, chr(10), '// note', chr(10), 'B', c_custkey, chr(10), 'c', chr(10), 'end', chr(10), 'd', chr(10)) when 1 then concat('a', c_custkey, chr(10), '// note', chr(10), 'q', c_custkey, chr(10), 'z', chr(10))
      when 2 then concat('a', c_custkey, chr(10), '// note', chr(10), 'b', chr(10), 'c', chr(10), 'd', chr(10)) else concat('new', c_custkey, chr(10)) end as text, case when c_custkey % 4 = 2 then 'block 1 not found' end as problem, case when c_custkey % 4 = 0 then '9' else '' end as rejected from customer"""
)
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patching.apply_changes(changes(spark, sf_dir))
    return df.select("id", "patch.text", "patch.problem", F.array_join(F.col("patch.rejected").cast("array<string>"), ",").alias("rejected"))


@query(
    """select c_custkey as id, x.place, 'a/x' as old_path, 'b/x' as new_path, x.a as old_start, x.b as old_count, x.c as new_start, x.d as new_count, case when x.place = 0 then 'part ' || c_custkey end as section,
      case x.place when 0 then ' a' || c_custkey || '|-b|+B' || c_custkey || '| c' when 1 then '-zz|+y' else '+end' end as lines from customer, (values (0, 1, 3, 1, 3), (1, 9, 1, 9, 1), (2, 4, 0, 5, 1)) as x(place, a, b, c, d) where c_custkey % 4 = 0"""
)
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = changes(spark, sf_dir).where("way = 'diff'")
    return patching.diff_hunks(df, "change").select("id", "place", "hunk.*").withColumn("lines", F.array_join("lines", "|"))
