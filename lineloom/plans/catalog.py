"""Registered queries and their SQL twins.

Each lineage operator runs on the given tables: nation-to-order keys as a call graph, page addresses as endpoints, document
texts as files; other modules add sources and statements that are made of the tables' rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import access as acc
from ..operators import batching, external, graph, matching, reports
from ..sources import files
from . import fixtures as J
from .fixtures import values_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(keys: DataFrame) -> DataFrame:
    """Rows of keys dealt to all tasks. Texts made of them are many times as large, so the splits of a small file would leave most cores idle."""
    return keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- files and dedup ------------------------------------------------------------------------------------------------

_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)"


@query(
    rf"""with p as (select page_id, {_PATH} as path from pages), x as (select *, string_split(path, '/') as parts from p)
    select page_id, path, parts[-1] as filename, substring(path, 2) as relative_path from x
    where not list_has_any(parts[:-2], ['en', 'target', 'build', 'out', 'bin']) and not starts_with(parts[-1], '.') and not starts_with(parts[-1], '1')"""
)
def file_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return files.keep(p, "path", extensions=(), exclude_dirs=("en",), exclude_files=("1*",)).select("page_id", "path", "filename", "relative_path")


@query("select digest, source, doc_id from (select md5(text) as digest, source, doc_id, row_number() over (partition by md5(text) order by doc_id desc) as n from documents) where n = 1")
def dedup_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "source", "doc_id")
    return graph.one_per_key(d, ["digest"], [F.desc("doc_id")])


@query("select conv_id, min_by(role, turn) as role, min(turn) as turn from conversations group by conv_id")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.one_per_key(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id"], [F.asc("turn")])


_REGIONS = """select cast(r_regionkey as varchar) as node, case when r_regionkey > 0 then cast(r_regionkey - 1 as varchar) else 'Object' end as parent from region
union all select concat('n', n_nationkey), cast(n_regionkey as varchar) from nation"""


@query(
    f"""with recursive p as ({_REGIONS}), a as (select node, parent as ancestor, 1 as depth from p where parent <> 'Object'
    union all select a.node, p.parent, a.depth + 1 from a join p on p.node = a.ancestor where p.parent <> 'Object') select node, ancestor, depth from a"""
)
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_REGIONS.replace("varchar", "string").replace("region\n", "{region}\n").replace("from nation", "from {nation}"), region=table(spark, sf_dir, "region"), nation=table(spark, sf_dir, "nation"))
    return graph.ancestors(p)


# --- call graph -----------------------------------------------------------------------------------------------------

EDGES = """select concat('R.', r_regionkey) as caller, concat('N.', n_nationkey) as callee from {region} join {nation} on n_regionkey = r_regionkey
union all select concat('N.', n_nationkey), concat('C.', c_custkey) from {nation} join {customer} on c_nationkey = n_nationkey
union all select concat('C.', c_custkey), concat('O.', o_orderkey) from {customer} join {orders} on o_custkey = c_custkey"""
_E = EDGES.replace("{", "").replace("}", "")
_REACH = f"""with recursive e as ({_E}), r as (select concat('R.', r_regionkey) as root, concat('R.', r_regionkey) as node, 0 as depth from region
  union all select r.root, e.callee, r.depth + 1 from r join e on e.caller = r.node where r.depth < 20)"""


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGES, **{t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders")})


def roots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("R."), "r_regionkey").alias("node"))


@query(f"select caller, callee from ({_E}) group by 1, 2")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(edges_of(spark, sf_dir))


@query(f"{_REACH} select root, node, min(depth) as depth from r group by 1, 2")
def endpoint_reach_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(edges_of(spark, sf_dir), roots_of(spark, sf_dir))


@query(
    f"""with recursive e as ({_E}), r as (select callee as root, callee as node, 0 as depth from e where callee like 'C.%' group by callee
    union all select r.root, e.caller, r.depth + 1 from r join e on e.callee = r.node where r.depth < 20) select root, node, min(depth) as depth from r group by 1, 2"""
)
def callers_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges_of(spark, sf_dir)
    return graph.callers(e, e.where("callee like 'C.%'").select(F.col("callee").alias("node")).distinct())


@query(f"{_REACH}, m as (select node from r where node like 'N.%' or node like 'R.%' group by node) select distinct m.node as method, r.root as endpoint from m join r on r.node = m.node where not exists (select 1 from r d where d.node = m.node and d.depth = 0) or r.depth = 0")
def method_to_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure = graph.reach(edges_of(spark, sf_dir), roots_of(spark, sf_dir)).where("node like 'N.%' or node like 'R.%'")
    return graph.method_endpoints(closure, closure.select(F.col("node").alias("method")).distinct())


_NEXT = "select distinct event_type as caller, nxt as callee from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from {events}) where nxt is not null"
_DUCK_NEXT = _NEXT.replace("{events}", "events")


@query(
    f"""with recursive e as ({_DUCK_NEXT}), p as (select caller as root, caller as node, 0 as depth, [caller] as path from e group by caller
    union all select p.root, e.callee, p.depth + 1, list_append(p.path, e.callee) from p join e on e.caller = p.node where not list_contains(p.path, e.callee))
    select root, node, min(depth) as depth, min_by(array_to_string(path, '>'), depth * 1000000 + rk) as path from (select *, row_number() over (partition by root, node order by depth, path) as rk from p) group by root, node"""
)
def shortest_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.sql(_NEXT, events=table(spark, sf_dir, "events"))
    got = graph.shortest_paths(e, e.select(F.col("caller").alias("node")).distinct())
    return got.select("root", "node", "depth", F.array_join("path", ">").alias("path"))


@query(
    f"""with recursive e as (select * from ({_DUCK_NEXT}) where caller <> callee), r as (select caller as root, callee as node from e union select r.root, e.callee from r join e on e.caller = r.node)
    select a.root as node, least(a.root, min(a.node)) as component from r a join r b on a.root = b.node and a.node = b.root where a.root <> a.node group by a.root"""
)
def cycle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(spark.sql(_NEXT, events=table(spark, sf_dir, "events")))


# --- endpoints and weights ------------------------------------------------------------------------------------------

_TEMPLATE = "regexp_replace(path, '[0-9]+', '{id}', 'g')"
_PLACE = "select path, page_id, length(html) % 7 as in_cnt, length(html) % 5 as out_cnt, page_id % 3 as kind from (select " + _PATH + " as path, page_id, html from pages)"


@query(
    f"""select * from {values_sql(J.ACCESS_FOUND, 'end_point, access_cnt')}
    union all select e.end_point, (select count(*) from ({_PLACE}) p where regexp_matches(p.path, '^' || replace(replace(e.end_point, '.', '[.]'), '{{id}}', '.+') || '$'))
    from (select distinct {_TEMPLATE} as end_point from ({_PLACE})) e where e.end_point like '%{{%'"""
)
def endpoint_access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = acc.endpoint_access(spark.createDataFrame(J.ACCESS_ENDPOINTS, "end_point string"), spark.createDataFrame(J.ACCESS_COUNTS, "path string, access_cnt long, ord int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    counts = p.groupBy("path").agg(F.count("*").alias("access_cnt"), F.min("page_id").alias("ord"))
    ends = p.select(F.regexp_replace("path", "[0-9]+", "{id}").alias("end_point")).where("end_point like '%{%'")
    return few.unionByName(acc.endpoint_access(ends, counts))


@query(
    f"""with q as (select {_TEMPLATE} as end_point, path, in_cnt + out_cnt * case kind when 0 then 1 when 1 then 20 else 100 end as weight from ({_PLACE})),
    w as (select end_point, sum(weight) as total_weight, count(*) as n_queries from q group by end_point),
    a as (select w.end_point, (select count(*) from q q2 where q2.path <> '' and regexp_matches(q2.path, '^' || replace(w.end_point, '{{id}}', '.+') || '$')) as c from w)
    select end_point, cast(total_weight as bigint) as total_weight, n_queries, cast(case when end_point = '' then 0 else c end as bigint) as access_cnt, cast(total_weight * case when end_point = '' then 0 else c end as bigint) as estimated_calls from w join a using (end_point)"""
)
def endpoint_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated calls by endpoint: weights of its queries times the accesses that its template counts, largest first."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"), F.length("html").alias("n"))
    kind = F.when(F.col("page_id") % 3 == 0, "single").when(F.col("page_id") % 3 == 1, "paged_list").otherwise("unpaged_list")
    weight = classify.weight(F.col("n") % 7, F.lit(1), F.col("n") % 5, kind, F.lit("Order"))
    q = p.select(F.regexp_replace("path", "[0-9]+", "{id}").alias("end_point"), F.lit("T").alias("table_name"), F.col("page_id").alias("query_id"), weight.cast("long").alias("weight"))
    counts = p.groupBy("path").agg(F.count("*").alias("access_cnt"), F.min("page_id").alias("ord")).where("path <> ''")
    r = acc.endpoint_rollup(q, acc.endpoint_access(q, counts))
    return r.drop("queries").orderBy(F.desc("estimated_calls"), "end_point")


_DEPTH = """select l_partkey, count(case when l_quantity < 20 then 1 end) as d0, count(case when l_quantity >= 20 and l_quantity < 35 then 1 end) as d1, count(case when l_quantity >= 35 then 1 end) as d2 from {lineitem} group by l_partkey"""


@query(
    f"""select l_partkey, d0, d1, d2, case when d2 > 0 then case when kind = 'single' then d0 + d1 + d2 else d0 + 10 * d1 + many * d2 end when d1 > 0 then d0 + many * d1 else d0 end as weight
    from (select *, case l_partkey % 3 when 0 then 'single' when 1 then 'paged_list' else 'unpaged_list' end as kind, case l_partkey % 3 when 0 then 1 when 1 then 20 else 100 end as many from ({_DEPTH.replace('{lineitem}', 'lineitem')}))"""
)
def loop_depth_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_DEPTH, lineitem=table(spark, sf_dir, "lineitem"))
    kind = F.when(F.col("l_partkey") % 3 == 0, "single").when(F.col("l_partkey") % 3 == 1, "paged_list").otherwise("unpaged_list")
    return d.withColumn("weight", batching.loop_weight(kind, F.col("d0"), F.col("d1"), F.col("d2")))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def reachable_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return acc.only_reachable(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# --- differences ----------------------------------------------------------------------------------------------------

_OLD = "select doc_id, case when doc_id % 7 = 0 then concat(text, '!') else text end as text from {documents} where doc_id % 11 <> 0"
_DUCK_OLD = _OLD.replace("{documents}", "documents")


def old_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_OLD, documents=table(spark, sf_dir, "documents"))


@query(f"select t.doc_id, case when o.doc_id is null then 'new' else 'changed' end as status from documents t left join ({_DUCK_OLD}) o on o.doc_id = t.doc_id where o.doc_id is null or o.text <> t.text")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.changed_files(table(spark, sf_dir, "documents").select("doc_id", "text"), old_documents(spark, sf_dir), key="doc_id")


@query(f"""select doc_id, count(*) as n_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents except all select doc_id, unnest(string_split(text, chr(10))) as line from ({_DUCK_OLD})) group by doc_id""")
def line_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.added_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), old_documents(spark, sf_dir), "doc_id", "text")


@query(f"select t.doc_id, 'replace' as tag, len(string_split(t.text, chr(10))) - 1 as old_start, len(string_split(t.text, chr(10))) as old_end from documents t join ({_DUCK_OLD}) o using (doc_id) where o.text <> t.text")
def line_diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = old_documents(spark, sf_dir).withColumnRenamed("text", "old").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("new")), "doc_id").where("old <> new")
    c = matching.line_changes(both, "old", "new").select("doc_id", F.explode("changes").alias("c"))
    return c.select("doc_id", "c.tag", F.col("c.old_start").cast("long").alias("old_start"), F.col("c.old_end").cast("long").alias("old_end"))


_RANGES = "select o_orderkey, o_custkey, o_orderdate as s, o_orderdate + interval '30' day as e from orders"


@query(f"select a.o_orderkey, count(*) as n_enclosing from ({_RANGES}) a join ({_RANGES}) b on a.o_custkey = b.o_custkey and a.s between b.s and b.e group by a.o_orderkey")
def interval_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("s"), F.expr("o_orderdate + interval 30 days").alias("e"))
    return acc.enclosing_counts(r, "o_orderkey", "o_custkey", "s", "e")


@query("select count(*) as n_all, count(l.doc_id) as n_found, count(*) - count(l.doc_id) as n_missing, round(100.0 * count(l.doc_id) / count(*), 1) as percent from (select distinct doc_id from documents) d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id")
def validation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select c_custkey, case when c_custkey % 5 = 0 then c_name || '*' else c_name end as c_name, c_acctbal from customer")
def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return acc.upsert(c, c.where("c_custkey % 5 = 0").withColumn("c_name", F.concat("c_name", F.lit("*"))), ["c_custkey"])


@query("select o_orderpriority, count(*) as total, count(*) filter (o_orderstatus = 'F') as success, count(*) filter (o_orderstatus <> 'F') as failed, count(distinct o_custkey) filter (o_orderstatus = 'F') as success_files from orders group by o_orderpriority")
def mod_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.modification_stats(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_custkey", "F")


@query(rf"select regexp_extract({_PATH}, '^/([a-z]+)/', 1) as keyword, count(*) as n_files from pages group by 1")
def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.keyword_groups(table(spark, sf_dir, "pages").select(F.expr(_PATH).alias("path")), "path")


# --- order-sensitive folds ------------------------------------------------------------------------------------------


@query(
    """with recursive d as (select source, doc_id, n_chars // 4 as t, row_number() over (partition by source order by doc_id) as n from documents),
    f as (select source, doc_id, n, 0 as batch, 100 + t as used from d where n = 1
      union all select d.source, d.doc_id, d.n, case when f.used + d.t + 1 > 8000 then f.batch + 1 else f.batch end, case when f.used + d.t + 1 > 8000 then 100 + d.t else f.used + d.t + 1 end
      from f join d on d.source = f.source and d.n = f.n + 1)
    select source, doc_id, batch from f"""
)
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.expr("n_chars div 4").alias("t"))
    return batching.greedy_batches(d, "source", "doc_id", "t", prompt=100, separator=1, budget=8000)


@query(
    """with recursive d as (select source, doc_id, n_chars // 4 as t, row_number() over (partition by source order by doc_id) as n from documents),
    f as (select source, doc_id, n, t <= 8000 as ok, case when t <= 8000 then t else 0 end as used from d where n = 1
      union all select d.source, d.doc_id, d.n, f.used + d.t <= 8000, case when f.used + d.t <= 8000 then f.used + d.t else f.used end from f join d on d.source = f.source and d.n = f.n + 1)
    select source, doc_id from f where ok"""
)
def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.expr("n_chars div 4").alias("t"))
    return batching.budget_select(d, "source", "doc_id", "t", budget=8000)


@query(
    """with n as (select user_id, event_type, row_number() over w as n, case when lag(event_type) over w = event_type then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
    r as (select *, sum(new) over (partition by user_id order by n) as run from n)
    select user_id, event_type, min(n) as first_row, max(n) as last_row from r group by user_id, run, event_type"""
)
def adjacent_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


# --- external calls -------------------------------------------------------------------------------------------------

@query("select conv_id, turn, md5('say: ' || text) as content, cast(8 as bigint) as tokens from conversations where text is not null")
def external_call_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    asked = table(spark, sf_dir, "conversations").where("text is not null").withColumn("prompt", external.render("say: {t}", t="text"))
    return external.call(asked, "prompt", lambda p: hashlib.md5(p.encode()).hexdigest()).select("conv_id", "turn", "content", "tokens")


# --- names, reports and checks --------------------------------------------------------------------------------------

_NAMES_A = "select concat('x.', lower(replace(p_type, ' ', '.'))) as a from {part}"
_NAMES_B = "select regexp_extract(lower(replace(p_type, ' ', '.')), '([^.]+[.][^.]+)$', 1) as b from {part} union all select concat('y.x.', lower(replace(p_type, ' ', '.'))) from {part}"


@query(f"select distinct a, b from ({_NAMES_A.replace('{part}', 'part')}) join ({_NAMES_B.replace('{part}', 'part')}) on a = b or a like concat('%.', b) or b like concat('%.', a)")
def signature_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return matching.signature_match(spark.sql(_NAMES_A, part=part), spark.sql(_NAMES_B, part=part), "a", "b")


@query(
    r"""select page_id, cast(row_number() over (order by case when ep = '' then 1 else 0 end, lower(ep), page_id) as bigint) as position
    from (select page_id, case when page_id % 5 = 0 then '' else url end as ep from pages where url is not null)"""
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.expr("case when page_id % 5 = 0 then '' else url end").alias("ep"))
    return acc.report_order(p, "ep", ["page_id"]).select("page_id", "position")


@query(
    """select l_orderkey, reported, actual, actual as corrected, reported is distinct from actual as was_wrong
    from (select l_orderkey, max(l_linenumber) as reported, cast(count(*) as int) as actual from lineitem where l_quantity > 5 group by l_orderkey)"""
)
def weight_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").where("l_quantity > 5").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("reported"), F.count("*").cast("int").alias("actual"))
    return acc.corrected(r, "reported", "actual")


@query("select source, cast(sum(length(text)) as bigint) as chars, cast(sum(length(text) // 4) as bigint) as tokens from documents group by source")
def text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.text_totals(table(spark, sf_dir, "documents"), "source", "text")


@query("select distinct doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def ids_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


# --- report fields --------------------------------------------------------------------------------------------------


_METHODS = "select concat(case when c_custkey % 3 = 0 then 'Y.' else 'X.' end, c_nationkey) as method from {customer}"
_HANDLERS = "select concat('X.', s_nationkey) as method, concat('/s/', s_suppkey) as path, s_suppkey as ord from {supplier}"


@query(
    f"""with h as ({_HANDLERS.replace("{supplier}", "supplier")}), k as (select method, arg_max(path, ord) as p, min(ord) as o from h group by method)
    select method, coalesce((select p from k where k.method = m.method), (select p from k where split_part(k.method, '.', 2) = split_part(m.method, '.', 2) order by o limit 1)) as path
    from (select distinct method from ({_METHODS.replace("{customer}", "customer")})) m"""
)
def endpoint_of_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.endpoint_of_methods(spark.sql(_METHODS, customer=table(spark, sf_dir, "customer")), spark.sql(_HANDLERS, supplier=table(spark, sf_dir, "supplier")))


@query("select concat('C', o_custkey, '.', o_orderstatus, '>O.', o_orderpriority) as stack from orders where o_custkey in (select c_custkey from customer where c_custkey % 3 = 0) group by 1")
def relevant_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = F.array(F.concat(F.lit("C"), "o_custkey", F.lit("."), "o_orderstatus"), F.concat(F.lit("O."), "o_orderpriority")).alias("stack")
    files = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("src/C"), "c_custkey", F.lit(".java")).alias("path"))
    return reports.relevant_stacks(table(spark, sf_dir, "orders").select(stack), files).select(F.array_join("stack", ">").alias("stack"))


@query(
    f"""with s as (select distinct concat('ns.', lower(o_orderstatus)) as namespace, split_part(o_orderpriority, '-', 1) as sql_id from orders), k as (select * from {values_sql(J.NAMESPACES, 'namespace, class_name, method, sql_id, ord')}),
    m as (select s.namespace, s.sql_id, k.class_name, k.method, row_number() over (partition by s.namespace, s.sql_id order by k.ord) as n from s left join k on k.namespace = s.namespace and (k.sql_id = s.sql_id or k.method = s.sql_id))
    select namespace, sql_id, coalesce(class_name, regexp_extract(namespace, '[^.]*$')) as class_name, coalesce(method, sql_id) as method from m where n = 1"""
)
def mapped_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.concat(F.lit("ns."), F.lower("o_orderstatus")).alias("namespace"), F.substring_index("o_orderpriority", "-", 1).alias("sql_id"))
    return reports.mapped_methods(s, spark.createDataFrame(J.NAMESPACES, "namespace string, class_name string, method string, sql_id string, ord int"))
