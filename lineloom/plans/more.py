"""Registered queries of parsers, scalar readings, rollups and sources that no other query calls, over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, javatext, sqltext
from ..operators import access as acc
from ..operators import external, graph, reports, resolve
from ..sources import files, javaparse, mapper, store
from . import shops
from .catalog import query, table

# --- parsers ----------------------------------------------------------------------------------------------------------

_MAPPER = r"""concat('<mapper namespace="a.M', s_suppkey, '"><!-- <select id="no">x</select> --><resultMap id="rm" type="V', s_suppkey % 5, '"><id property="id" column="ID', s_suppkey, '"/><result property="name" column="NAME"/></resultMap><sql id="cols">id, name', s_suppkey,
  '</sql><select id="get" resultMap="rm" parameterType="long">SELECT <include refid="cols"/> FROM t', s_suppkey, ' <where><if test="x">AND id = #', '{id}</if></where></select>', case when s_suppkey % 2 = 0 then concat('<update id="put">UPDATE t <set><if test="a">a = #', '{a},</if></set></update>') else '' end,
  case when s_suppkey % 7 = 3 then '' else '</mapper>' end)"""


@query(
    """with k as (select s_suppkey as k, 'm/' || s_suppkey || '.xml' as path from supplier)
    select path, 'a.M' || k as namespace, 'select' as tag, 'get' as sql_id, 'long' as parameter_type, 'V' || k % 5 as result_type, 'rm' as result_map, 'SELECT FROM t' || k || ' AND id = #{id}' as sql, 'SELECT id, name' || k || ' FROM t' || k || ' WHERE id = #{id}' as resolved, 'name:NAME,id:ID' || k as fields, false as failed from k where k % 7 <> 3
    union all select path, 'a.M' || k, 'update', 'put', null, null, null, 'UPDATE t a = #{a},', 'UPDATE t SET a = #{a}', '', false from k where k % 7 <> 3 and k % 2 = 0
    union all select path, null, null, null, null, null, null, null, null, '', true from k where k % 7 = 3"""
)
def mapper_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all suppliers' mapper files, dynamic tags resolved; broken files give their error."""
    sources = table(spark, sf_dir, "supplier").select(F.expr("concat('m/', s_suppkey, '.xml')").alias("path"), F.expr(_MAPPER).alias("text"))
    fields = F.array_join(F.transform("mappings", lambda m: F.concat_ws(":", m["java_field"], m["db_column"])), ",")
    return mapper.statements(sources).select("path", "namespace", "tag", "sql_id", "parameter_type", "result_type", "result_map", "sql", "resolved", fields.alias("fields"), F.col("error").isNotNull().alias("failed"))


@query("select 'C' || s_suppkey as class_name, 'find' as method_name, 'GET' as http_method, '/c' || s_suppkey || '/find/{id}' as end_point from supplier union all select 'C' || s_suppkey, 'add', 'POST', '/c' || s_suppkey || '/add' from supplier")
def rest_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers of all suppliers' controllers."""
    return javatext.endpoints(shops.shops(spark, sf_dir)).drop("path")


@query(
    """select 'p' || s_suppkey || '/web/C' || s_suppkey || '.java' as path, 'C' || s_suppkey as classes, 'find,add,check' as methods, 'svc' as fields from supplier union all select 'p' || s_suppkey || '/svc/S' || s_suppkey || '.java', '', 'load,save', '' from supplier
    union all select 'p' || s_suppkey || '/svc/S' || s_suppkey || 'Impl.java', 'S' || s_suppkey || 'Impl', 'load,save,retry', 'mapper' from supplier union all select 'p' || s_suppkey || '/db/M' || s_suppkey || '.java', '', 'select,insert,all', '' from supplier"""
)
def java_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of classes, methods and fields of all suppliers' files, by pattern."""
    text = F.col("text")
    return shops.shops(spark, sf_dir).select("path", F.array_join(javatext.class_names(text), ",").alias("classes"), F.array_join(javatext.method_names(text), ",").alias("methods"), F.array_join(javatext.field_names(text), ",").alias("fields"))


@query(
    """select 'J' || p_partkey as path, x.kind, x.a || p_partkey || x.b as sql from part, (values ('jdbc', 'SELECT ', ' "x"', 0), ('jdbc', 'DELETE ', '', 1), ('jpa_query', 'FROM U', '', 2), ('jpa_named', 'FROM N', '', 3), ('jpa_create', 'SELECT ', '', 4)) as x(kind, a, b, n) where p_partkey % 5 >= x.n"""
)
def embedded_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in string literals of JDBC calls and JPA annotations, of a file for each part."""
    text = r"""concat('c.prepareStatement( "SELECT ', p_partkey, ' \\"x\\"" ); // c.execute("no")\n', case when p_partkey % 5 >= 1 then concat('s.executeUpdate("DELETE ', p_partkey, '");') else '' end, case when p_partkey % 5 >= 2 then concat('@Query(value = "FROM U', p_partkey, '")') else '' end,
      case when p_partkey % 5 >= 3 then concat('@NamedQuery(name = "n", query = "FROM N', p_partkey, '")') else '' end, case when p_partkey % 5 >= 4 then concat('em.createNativeQuery("SELECT ', p_partkey, '");') else '' end)"""
    sources = table(spark, sf_dir, "part").select(F.expr("concat('J', p_partkey)").alias("path"), F.expr(text).alias("text"))
    return javatext.embedded_sql(sources).withColumn("sql", F.replace("sql", F.lit('\\"'), F.lit('"')))


# --- scalar readings --------------------------------------------------------------------------------------------------

_KIND = "case p_partkey % 6 when 0 then concat('List<V', p_partkey, '>') when 1 then 'void' when 2 then 'MultipartFile[]' when 3 then concat('Map<String, V', p_size, '>') when 4 then 'PageList<X>' else concat('V', p_partkey) end"


@query(
    """with k as (select p_partkey as k, p_partkey % 6 as m, p_size as z from part)
    select k, case m when 0 then 'V' || k when 1 then 'void' when 2 then 'MultipartFile[]' when 3 then 'V' || z when 4 then 'X' else 'V' || k end as inner_type, case m when 1 then 'none' when 5 then 'single' else 'multiple' end as cardinality,
      case m when 0 then 'List' when 1 then 'void' when 2 then 'MultipartFile[]' when 3 then 'Map' when 4 then 'PageList' else 'V' || k end as simple_type, case m when 0 then 'unpaged_list' when 2 then 'unpaged_list' when 4 then 'paged_list' else 'single' end as inline,
      case when m = 2 then 1000.0 else 1.0 end as in_weight, case m when 0 then 'Dao' when 1 then 'Ctl' else 'Unknown' end as layer, case m when 0 then 'DAO' when 1 then '' when 2 then 'Mapper' else '' end as program,
      'F' || k as stem, case when m = 3 then '''=' || k else '' || k end as cell, (length('' || k)) // 4 as tokens, case when m = 4 then null else '{"a": ' || k || '}' end as object from k"""
)
def type_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the types, names, paths and answers of all parts are read as."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_KIND).alias("kind"), F.expr("case p_partkey % 6 when 0 then concat('X', p_partkey, 'Dao') when 1 then concat('X', p_partkey, 'Ctl') when 2 then 'XMapperX' else 'X' end").alias("name"), F.expr("concat('a/b.c/F', p_partkey, '.java')").alias("path"), F.expr(r"case when p_partkey % 6 = 3 then concat('=', '\u0001', p_partkey) else concat('', p_partkey) end").alias("cell"), F.expr(r"case p_partkey % 6 when 4 then 'no {json' when 5 then concat('so: ```json\n{\"a\": ', p_partkey, ',}\n```') else concat('text {\"a\": ', p_partkey, '} end') end").alias("answer"))
    kind = F.col("kind")
    return rows.select(
        "k", javatext.inner_type(kind).alias("inner_type"), javatext.cardinality(kind).alias("cardinality"), classify.simple_type(kind).alias("simple_type"), classify.data_type_inline(kind, F.lit("SELECT 1")).alias("inline"), classify.input_weight(kind).alias("in_weight"),
        classify.layer_by_suffix(F.col("name"), [("Dao", ["Dao", "DAO"]), ("Ctl", ["Ctl"])]).alias("layer"), classify.program_type(F.col("name"), F.lit("")).alias("program"), classify.file_stem(F.col("path")).alias("stem"), classify.for_sheet(F.col("cell")).alias("cell"),
        classify.token_size(F.col("k").cast("string")).alias("tokens"), F.regexp_replace(classify.json_object(F.col("answer")), ",}", "}").alias("object"),
    )


@query(
    f"""select sql_id, case when m in (0, 1, 5) then lower(c) when m = 2 then lower(c) || ',' || lower(o) when m = 3 then 'sales.' || lower(c) || ',sales.' || lower(o) when m in (4, 6) then lower(o) else 'part' end as tables,
    case m when 0 then 'c_acctbal,c_name' when 2 then 'c_name,o_totalprice' when 3 then 'c_name,o_orderkey' when 7 then 'p_name' else '' end as plain from {shops._K}"""
)
def other_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified tables and plain columns of all orders' statements."""
    sql = F.col("sql")
    return shops.statements(spark, sf_dir).select("sql_id", F.array_join(sqltext.qualified_tables(sql), ",").alias("tables"), F.array_join(sqltext.plain_columns(sql), ",").alias("plain"))


# --- rollups ----------------------------------------------------------------------------------------------------------

_CALLS = "select case when o_orderkey % 13 = 0 then ' ' when o_orderkey % 17 = 0 then null else concat('/e', o_custkey % 40) end as end_point, o_orderkey % 5 as weight from {orders}"
_HITS = "select concat('/e', c_custkey) as end_point, cast(c_custkey % 4 as bigint) as access_cnt from {customer} where c_custkey < 30"


@query(
    f"""with c as ({_CALLS.replace("{orders}", "orders")}), a as ({_HITS.replace("{customer}", "customer")}), r as (select end_point, sum(weight) as w from c where trim(coalesce(end_point, '')) <> '' group by 1)
    select end_point, cast(w as bigint) as total_weight, cast(case when access_cnt > 0 then w * access_cnt else w end as bigint) as estimated_calls from r left join a using (end_point)
    union all select 'all', count(*), cast(coalesce(sum(case when access_cnt > 0 then w * access_cnt else w end), 0) as bigint) from r left join a using (end_point)"""
)
def code_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated calls of each end point, and the totals of the report."""
    rolled = acc.code_rollup(spark.sql(_CALLS, orders=table(spark, sf_dir, "orders")), spark.sql(_HITS, customer=table(spark, sf_dir, "customer")))
    totals = acc.report_totals(rolled).select(F.lit("all").alias("end_point"), F.col("n_endpoints").alias("total_weight"), F.col("estimated_calls").cast("long").alias("estimated_calls"))
    return rolled.select("end_point", F.col("total_weight").cast("long").alias("total_weight"), F.col("estimated_calls").cast("long").alias("estimated_calls")).unionByName(totals)


@query(
    f"""with m as (select distinct 'm' || s_suppkey % 30 as method, '/e' || s_nationkey as end_point from supplier), a as ({_HITS.replace("{customer}", "customer")})
    select method, cast(coalesce(sum(access_cnt), 0) as bigint) as access_cnt, min(end_point) as first_one from m left join a using (end_point) group by method"""
)
def method_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of all end points that reach a method, and the first of these."""
    m = table(spark, sf_dir, "supplier").selectExpr("concat('m', s_suppkey % 30) as method", "concat('/e', s_nationkey) as endpoint").distinct()
    return acc.method_access(m, spark.sql(_HITS, customer=table(spark, sf_dir, "customer"))).withColumnRenamed("primary", "first_one")


@query(
    f"""with a as ({shops._FOUND}), l as ({shops._LAYERS.replace("{orders}", "orders")}), f as (select table_name, layer, string_agg(distinct file, ',' order by file) as files from a join l using (file) group by 1, 2) select table_name, layer, files from f"""
)
def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each table's accesses by layer."""
    s = shops.statements(spark, sf_dir)
    layers = spark.sql(shops._LAYERS, orders=table(spark, sf_dir, "orders"))
    rolled = acc.table_rollup(acc.watched_access(s, shops.watched(spark, sf_dir)).join(layers, "file"), s)
    return rolled.select("table_name", F.explode("layer_files").alias("layer", "files")).withColumn("files", F.array_join("files", ","))


@query(
    """with l as (select l_suppkey as k, case when l_partkey % 3 = 0 then 'a.N' || l_partkey % 40 else 'N' || l_partkey % 40 end as name, l_orderkey, l_linenumber from lineitem), r as (select p_size % 25 as k, case when p_partkey % 2 = 0 then 'A.n' || p_partkey % 40 else 'b.N' || p_partkey % 40 end as name, p_partkey as o, p_name as v from part)
    select l_orderkey, l_linenumber, name, v from (select l.l_orderkey, l.l_linenumber, l.name, r.v, row_number() over (partition by l.l_orderkey, l.l_linenumber, l.k, l.name order by case when lower(l.name) = lower(r.name) then 0 else 1 end, r.o) as n
      from (select distinct * from l) l join r on r.k = l.k and (lower(r.name) = lower(l.name) or string_split(lower(l.name), '.')[-1] = string_split(lower(r.name), '.')[-1])) where n = 1"""
)
def names_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part for each line item of a small supplier: by name, else by the last part of the name."""
    left = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as k", "case when l_partkey % 3 = 0 then concat('a.N', l_partkey % 40) else concat('N', l_partkey % 40) end as name", "l_orderkey", "l_linenumber").distinct()
    right = table(spark, sf_dir, "part").selectExpr("p_size % 25 as k", "case when p_partkey % 2 = 0 then concat('A.n', p_partkey % 40) else concat('b.N', p_partkey % 40) end as name", "p_partkey as o", "p_name as v")
    return acc.with_fallback(left, right, ["k"], "name", "o").select("l_orderkey", "l_linenumber", "name", "v")


# --- graphs -----------------------------------------------------------------------------------------------------------


@query(f"select node, min(file) as file from (select caller as node, case when caller like 'C%' then 'web' else 'impl' end as file from ({shops._ALL}) union all select callee, case when callee like 'M%' then 'db' when callee like '%Impl.%' then 'impl' when callee like 'S%' then 'svc' else 'web' end from ({shops._ALL})) group by node")
def node_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each node of the suppliers' call graphs, by kind."""
    kind = lambda c: F.when(F.col(c).contains("/db/"), "db").when(F.col(c).endswith("Impl.java"), "impl").when(F.col(c).contains("/svc/"), "svc").otherwise("web").alias(c)
    return resolve.edges_with_files(shops.edges_of(spark, sf_dir).select("caller", "callee", kind("caller_file"), kind("callee_file")))


@query(f"select s || '.load' as caller, i || '.load' as callee from {shops._S} union all select caller, callee from ({shops._DIRECT})")
def endpoint_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from end points on interface methods to the classes that define them."""
    t = shops.types_of(spark, sf_dir)
    m = javaparse.methods(t)
    points = table(spark, sf_dir, "supplier").selectExpr("explode(array(concat('S', s_suppkey, '.load'), concat('S', s_suppkey, '.gone'))) as signature")
    return resolve.expand_endpoints(resolve.call_edges(t, m), points, t, m).select("caller", "callee").distinct()


@query(
    f"""with w as (select m || '.insert' as wanted, m || '.insert' as node, c, i, k from {shops._S} where k % 3 = 0 union all select 'x.y.' || i || '.load', 'S0.load', 'C0', 'S0Impl', k from {shops._S} where k % 3 = 1)
    select wanted, 'controller' as layer, c || '.java' as files from w union all select wanted, 'service', i || '.java' from w where k % 3 = 0"""
)
def callers_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of what calls wanted methods, by layer; names that no node has fall back to the last name."""
    edges = shops.edges_of(spark, sf_dir)
    wanted = table(spark, sf_dir, "supplier").where("s_suppkey % 3 < 2").selectExpr("case when s_suppkey % 3 = 0 then concat('M', s_suppkey, '.insert') else concat('x.y.S', s_suppkey, 'Impl.load') end as wanted")
    nodes = edges.selectExpr("explode(array(caller, callee)) as node").distinct()
    layer = F.when(F.col("node").rlike(r"^C\d"), "Controller").when(F.col("node").contains("Impl."), "Service").otherwise("Unknown")
    nodes = nodes.select("node", layer.alias("layer"), F.concat(F.substring_index("node", ".", 1), F.lit(".java")).alias("file"))
    return graph.callers_with_layers(edges, wanted, nodes).withColumn("files", F.array_join("files", ","))


@query(f"with e as (select distinct caller, callee from ({shops._ALL}) where caller not like '%.retry' or caller in (select callee from ({shops._ALL}))) select caller, callee from e")
def edges_of_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges rebuilt from the saved trees of all suppliers' controllers."""
    return graph.edges_of_paths(shops.tree_of(spark, sf_dir))


# --- reports and calls ------------------------------------------------------------------------------------------------


@query(
    """select o_orderkey, case when o_orderkey % 3 = 0 then '' else 'C' || o_custkey || ',' || chr(10) || 'D' end as first_frames, case when o_orderkey % 4 = 0 then 'b' when o_orderkey % 4 = 1 then 'a' || o_orderkey || ', b' else 'b, c' end as fields from orders"""
)
def frames_and_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First frames of stacks and encrypted fields of mappings, each once, for all orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderkey % 3 = 0, array(), array(array(concat(' C', o_custkey), 'x'), array(' '), array('D'), array(concat('C', o_custkey, ' '))))").cast("array<array<string>>").alias("stacks"), F.expr("case o_orderkey % 4 when 0 then null when 1 then array(concat('a', o_orderkey), ' ', 'b') else array('b') end").alias("i"), F.expr("case when o_orderkey % 4 < 2 then array('b', null) else array(' c', 'b') end").alias("o"))
    return rows.select("o_orderkey", reports.first_frames(F.col("stacks")).alias("first_frames"), reports.crypto_fields(F.col("i"), F.col("o")).alias("fields"))


@query("select conv_id, turn, case when turn % 3 = 2 then null else 'said ' || role || turn % 3 end as content, case when turn % 3 <> 2 then (length('said ' || role) + 1) // 4 end as tokens from conversations where role is not null")
def calls_that_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside calls of which some fail once and some always; equal prompts are asked once."""
    tried: dict[str, int] = {}

    def provider(p: str) -> str:
        tried[p] = tried.get(p, 0) + 1
        if p.endswith("2") or p.endswith("1") and tried[p] == 1:
            raise ValueError(p)
        return f"said {p}"

    asked = table(spark, sf_dir, "conversations").where("role is not null").withColumn("prompt", F.expr("concat(role, turn % 3)"))
    return external.call(asked, "prompt", provider, retries=1, first_wait=0.01).select("conv_id", "turn", "content", "tokens")


# --- sources ----------------------------------------------------------------------------------------------------------


@query("select 'g=' || s_suppkey % 4 as folder, '.csv' as extension, cast(sum(length('' || s_suppkey) + 3) as bigint) as bytes, cast(sum(length('' || s_suppkey) + 3) as bigint) as letters, max(s_suppkey % 4 > 1) as asked from supplier where s_suppkey % 3 = 0 group by s_suppkey % 4")
def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files in Latin-1, written from all suppliers, scanned without excluded folders, decoded, and met with a parse cache."""
    folder = store.shared_folder(spark, "tree")
    rows = table(spark, sf_dir, "supplier").selectExpr("concat('ÿÿ', s_suppkey) as v", "element_at(array('src', 'build', 'x'), cast(s_suppkey % 3 + 1 as int)) as d", "s_suppkey % 4 as g")
    rows.write.partitionBy("d", "g").option("encoding", "ISO-8859-1").csv(folder)
    found = files.scan(spark, folder, extensions=(".CSV",), exclude_dirs=("d=build",), exclude_files=("*d=x/*",), content=True)
    group = F.element_at(F.split("path", "/"), -2)
    fresh = files.to_parse(found, found.where(group.isin("g=0", "g=1"))).select("path", F.lit(True).alias("asked"))
    out = found.join(fresh, "path", "left").groupBy(group.alias("folder"), "extension")
    return out.agg(F.sum("size").alias("bytes"), F.sum(F.length(files.text(F.col("content")))).cast("long").alias("letters"), F.coalesce(F.max("asked"), F.lit(False)).alias("asked"))


@query(
    """with c as (select '/p' || c_custkey % 50 as p, c_custkey % 7 as n, c_custkey as o from customer where c_custkey % 5 < 2 and c_custkey % 50 <> 17) select 'count' as list, p as name, cast(arg_max(n, o) as bigint) as n from c group by p
    union all select 'changed', 'src/F' || c_custkey % 90 || '.java', null from customer where c_custkey % 5 > 0 group by 2 union all select 'latest', ts, n from (select c_custkey % 3 as ts0, '2024' || c_custkey % 3 as ts, count(*) as n from customer group by 1, 2) where ts = (select max('2024' || c_custkey % 3) from customer)"""
)
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access counts and changed files read from lists, the latest partition, and the last version of a stored table, of all customers."""
    folder, customer = store.shared_folder(spark, "lists"), table(spark, sf_dir, "customer")
    line = "case c_custkey % 5 when 0 then concat('/p', c_custkey % 50, ', ', c_custkey % 7) when 1 then concat(' /p', c_custkey % 50, '  ', c_custkey % 7) when 2 then '' when 3 then concat('/p', c_custkey, ',many') else concat('/alone', c_custkey) end"
    customer.where("c_custkey % 50 <> 17").repartition(1).sortWithinPartitions("c_custkey").select(F.expr(line).alias("value")).write.text(f"{folder}/counts")
    changed = r"case c_custkey % 5 when 0 then concat('# F', c_custkey) when 1 then concat('//src/F', c_custkey % 90, '.java') when 2 then concat('src\\\\F', c_custkey % 90, '.java') else concat(' src//F', c_custkey % 90, '.java ') end"
    customer.select(F.expr(changed).alias("value")).write.text(f"{folder}/changed")
    files.save(customer.limit(1).selectExpr("'old' as ts"), f"{folder}/table")
    files.save(files.latest(customer.selectExpr("concat('2024', c_custkey % 3) as ts")), f"{folder}/table")
    kept = files.load(spark, f"{folder}/table", "ts string").groupBy(F.col("ts").alias("name")).agg(F.count("*").alias("n"))
    out = files.access_counts(spark, f"{folder}/counts").select(F.lit("count").alias("list"), F.col("end_point").alias("name"), F.col("access_cnt").alias("n"))
    out = out.unionByName(files.changed_files(spark, f"{folder}/changed").select(F.lit("changed").alias("list"), F.col("relative_path").alias("name"), F.lit(None).cast("long").alias("n")))
    return out.unionByName(kept.select(F.lit("latest").alias("list"), "name", "n"))
