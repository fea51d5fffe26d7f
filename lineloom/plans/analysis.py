"""Registered queries of the analysis report: its outer join and ordered lists, over rows made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discover, lineage, reconcile
from .catalog import query, spread, table

_ID = "concat(case {0} % 3 when 0 then 'a.b.' when 1 then 'c.' else '' end, 'Q', {0} % {1})"
_ACCESS = f"""select concat('T', o_custkey % 50) as table_name, case when o_orderkey % 97 = 5 then null else {_ID.format("o_orderkey", 211)} end as sql_id, o_orderkey as ord,
  case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then null else concat('src/m/M', o_custkey % 9, '.xml') end as source_path,
  case when o_orderkey % 3 = 0 then array(concat('src/d/D', o_custkey % 7, '.java')) else cast(array() as array<string>) end as access_files,
  case when o_orderkey % 5 = 0 then cast(array() as array<array<string>>) else array(array(concat('C', o_custkey % 11, '.go'), 'S.do'), array('  '), array(concat('C', o_orderkey % 11, '.go ')), array(concat('C', o_custkey % 11, '.go'))) end as stacks,
  case when o_orderkey % 6 < 2 then '' else 'map' end as result_map, case when o_orderkey % 7 = 0 then null else cast(o_orderkey % 4 as int) end as n_fields from {{orders}}"""
_ANALYSED = f"""select concat('T', c_custkey % 60) as table_name, {_ID.format("c_custkey", 211)} as query_id, c_custkey % 100 as ord, case c_custkey % 4 when 0 then 'VO' when 1 then 'MAP' when 2 then 'LIST' end as in_category,
  concat('In', c_custkey % 5) as in_class, case when c_custkey % 3 = 0 then 'VO' else 'NONE' end as out_category, case when c_custkey % 2 = 0 then concat('In', c_custkey % 3) else '' end as out_class, c_name as summary from {{customer}}"""
_FLOWS = f"select concat('T', p_partkey % 55) as table_name, {_ID.format('(p_partkey + 1)', 211)} as query_id, p_partkey % 77 as ord, case when p_partkey % 8 = 0 then null else p_partkey % 300 end as flow_id from {{part}}"
_TOLD = f"""select concat('T', s_suppkey % 55) as table_name, case when s_suppkey % 2 = 0 then s_suppkey % 300 end as flow_id, case when s_suppkey % 3 > 0 then {_ID.format("s_suppkey", 211)} end as query_id, s_suppkey as ord,
  concat('F', s_suppkey, '.java') as file_name, concat('m', s_suppkey % 10) as method, case when s_suppkey % 4 = 0 then null else 'EDIT' end as action from {{supplier}}"""


def _duck(sql: str, **names: str) -> str:
    out = sql.format(**names)
    for a, b in (("cast(array() as array<string>)", "cast([] as varchar[])"), ("cast(array() as array<array<string>>)", "cast([] as varchar[][])")):
        out = out.replace(a, b)
    while "array(" in out:
        i = out.index("array(")
        depth, j = 0, i + 5
        while True:
            depth += {"(": 1, ")": -1}.get(out[j], 0)
            if not depth:
                break
            j += 1
        out = f"{out[:i]}[{out[i + 6 : j]}]{out[j + 1 :]}"
    return out


_LAST = "string_split({0}, '.')[-1]"


@query(
    f"""with acc as ({_duck(_ACCESS, orders="orders")}), ana as ({_duck(_ANALYSED, customer="customer")}), flo as ({_duck(_FLOWS, part="part")}), ins as ({_duck(_TOLD, supplier="supplier")}),
    b as (select *, {_LAST.format("sql_id")} as token, coalesce(nullif(source_path, ''), access_files[1], stacks[1][1]) as path, list_filter(list_transform(stacks, lambda x: trim(x[1])), lambda x: x <> '') as fr from acc),
    sh as (select table_name, token, arg_min(row(case when coalesce(result_map, '') = '' then 'X' when coalesce(n_fields, 0) = 0 then '△' else '○' end, list_filter(fr, lambda x, i: list_position(fr, x) = i)), row(ord, sql_id)) as st,
      arg_min(path, row(ord, sql_id)) filter (path is not null) as mapper from b where token is not null group by table_name, token),
    a0 as (select distinct on (table_name, query_id) * from ana order by table_name, query_id, ord, in_category nulls first, in_class, out_category, out_class, summary),
    a1 as (select distinct on (table_name, t) *, from (select *, {_LAST.format("query_id")} as t from ana) order by table_name, t, ord, query_id, in_category nulls first, in_class, out_category, out_class, summary),
    f0 as (select distinct on (table_name, query_id) * from flo order by table_name, query_id, ord, flow_id nulls first),
    f1 as (select distinct on (table_name, t) * from (select *, {_LAST.format("query_id")} as t from flo) order by table_name, t, ord, query_id, flow_id nulls first),
    i0 as (select table_name, flow_id, min(row(ord, file_name, method, action)) as i from ins where flow_id is not null group by table_name, flow_id),
    i1 as (select table_name, query_id, min(row(ord, file_name, method, action)) as i from ins where query_id is not null group by table_name, query_id),
    r as (select b.table_name, b.sql_id, b.token, b.ord, sh.mapper, sh.st, coalesce(a0.query_id, a1.query_id) as aq, coalesce(f0.query_id, f1.query_id) as fq, case when f0.query_id is not null then f0.flow_id else f1.flow_id end as flow_id,
        case when a0.query_id is not null then a0 else null end as e0, a1 as e1
      from b left join sh on sh.table_name = b.table_name and sh.token = b.token left join a0 on a0.table_name = b.table_name and a0.query_id = b.sql_id left join a1 on a1.table_name = b.table_name and a1.t = b.token
        left join f0 on f0.table_name = b.table_name and f0.query_id = b.sql_id left join f1 on f1.table_name = b.table_name and f1.t = b.token),
    u as (select table_name, sql_id, token, ord, mapper, st, case when aq is not null and fq is not null then 'both' when aq is not null then 'analysed' when fq is not null then 'planned' else 'neither' end as found, fq, flow_id,
        case when aq is null then null when e0 is not null then e0.in_category else e1.in_category end as ic, case when aq is null then null when e0 is not null then e0.in_class else e1.in_class end as il,
        case when aq is null then null when e0 is not null then e0.out_category else e1.out_category end as oc, case when aq is null then null when e0 is not null then e0.out_class else e1.out_class end as ol,
        case when aq is null then null when e0 is not null then e0.summary else e1.summary end as summary, aq is not null as known from r
      union all select table_name, query_id, {_LAST.format("query_id")}, null, null, null, 'only analysed', null, null, in_category, in_class, out_category, out_class, summary, true from a0 where not exists (select 1 from b where b.table_name = a0.table_name and b.token = {_LAST.format("a0.query_id")})
      union all select table_name, query_id, {_LAST.format("query_id")}, null, null, null, 'only planned', query_id, flow_id, null, null, null, null, null, false from f0 where not exists (select 1 from b where b.table_name = f0.table_name and b.token = {_LAST.format("f0.query_id")})),
    v as (select u.*, case when fq is null then null when i0.i is not null then i0.i else i1.i end as i from u left join i0 on i0.table_name = u.table_name and i0.flow_id = u.flow_id left join i1 on i1.table_name = u.table_name and i1.query_id = u.sql_id)
    select table_name, sql_id, token as display_id, ord, string_split(mapper, '/')[-1] as mapper, st[1] as result_map, array_to_string(st[2], ',' || chr(10)) as end_point, replace(i[2], '.java', '') as class_name, i[3] as method, i[4] as action,
      array_to_string(list_sort(list_distinct(list_filter([case when ic in ('VO', 'MAP') then nullif(il, '') end, case when oc in ('VO', 'MAP') then nullif(ol, '') end], lambda x: x is not null))), ', ') as model, summary, found from v"""
)
def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all orders against analysed queries of all customers, flows of all parts and instructions of all suppliers."""
    made = lambda sql, name: spark.sql(sql, **{name: table(spark, sf_dir, name)})
    return reconcile.report(made(_ACCESS, "orders"), made(_ANALYSED, "customer"), made(_FLOWS, "part"), made(_TOLD, "supplier"))


@query(
    """with f as (select l_suppkey, trim(l_returnflag || ' ' || case when l_partkey % 5 = 0 then ' ' else cast(l_partkey % 17 as varchar) end) as v, min(l_orderkey * 10 + l_linenumber) as pos from lineitem where l_partkey % 5 > 0 group by 1, 2)
    select l_suppkey, string_agg(v, ', ' order by pos, v) as marks from f group by l_suppkey"""
)
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct marks of every supplier's line items in first-seen order."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr("case when l_partkey % 5 = 0 then ' ' else concat(' ', l_returnflag, ' ', l_partkey % 17, ' ') end").alias("mark"), F.expr("l_orderkey * 10 + l_linenumber").alias("at"))
    return reconcile.ordered_distinct(rows, ["l_suppkey"], "mark", "at", "marks")


_KEYS = ["l_returnflag", "l_linestatus", "nullif(l_linenumber, 3) as line", "cast(l_quantity as int) % 5 as q", "l_suppkey % 3 as s", "nullif(l_partkey % 4, 1) as p", "cast(round(l_tax * 100) as int) % 3 as t"]


@query(
    f"""select l_returnflag, l_linestatus, line, q, s, p, t, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_returnflag, l_linestatus, line, q, s, p, t order by l_orderkey * 10 + l_linenumber) as n
    from (select {', '.join(_KEYS)}, l_orderkey, l_linenumber from lineitem)) where n = 1"""
)
def first_of_seven_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line item of each combination of seven columns, nulls included."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_KEYS, "l_orderkey", "l_linenumber", "l_orderkey * 10 + l_linenumber as at")
    return reconcile.first_rows(rows, ["l_returnflag", "l_linestatus", "line", "q", "s", "p", "t"], "at").drop("at")


_BATCHES = "select concat('/b', s_suppkey % 7, '/J', s_suppkey, case when s_suppkey % 4 = 0 then '_SQL.XML' else '_SQL.xml' end) as path from {supplier}"
_STEM = "case when c_custkey >= 300 then concat('X', c_custkey) when c_custkey % 3 = 0 then concat('J', c_custkey % 100) when c_custkey % 3 = 1 then concat('j', c_custkey % 100) else concat('K', c_custkey % 100) end"
_JAVA = f"""select concat('/b', c_custkey % 7, '/', {_STEM}, '.java') as path, concat('class A {{{{ void go() {{{{ // setQueryPath("J7_SQL.xml")\n', case when c_custkey % 5 = 0 then
  concat('q.setQueryPath( dir + "/sub/J', c_custkey % 150, '_sql.xml");\nq.setQueryPath(path, "J', c_custkey % 31, '_SQL.xml")') when c_custkey % 5 = 1 then concat('q.setOther("J', c_custkey % 150, '_SQL.xml")') else 'x = 1' end, ';}}}} }}}}') as text from {{customer}}"""
_CONFIGS = r"""select concat('/cfg/P', p_partkey, case when p_partkey % 3 = 0 then '_cfg.xml' else '_CFG.xml' end) as path, concat('<jobs><!-- <step query-file="J1_SQL.xml" class="k.C1"/> -->', case when p_partkey % 20 = 0 then
  concat('<step class="', case p_partkey % 3 when 0 then 'k.' when 1 then 'other.' else '' end, 'C', p_partkey % 40, '" text="a > b" query-file="a/b/J', p_partkey % 120, '_SQL.xml"/><step query-file="J', p_partkey % 90, '_SQL.xml"/>') else '' end,
  case when p_partkey % 35 = 0 then concat('<step query-file=''J', p_partkey % 110, '_sql.xml'' class=''k.C', p_partkey % 29, '''></step>') else '' end, '</jobs>') as text from {part}"""
_CLASSES = "select distinct concat('C', c_custkey % 30) as class_name, concat('k.C', c_custkey % 30) as full_name, concat('/k/C', c_custkey % 30, '.java') as path from {customer}"


@query(
    f"""with q as (select s_suppkey as s, path from (select s_suppkey, concat('/b', s_suppkey % 7, '/J', s_suppkey, case when s_suppkey % 4 = 0 then '_SQL.XML' else '_SQL.xml' end) as path from supplier)),
    j as (select c_custkey as c, c_custkey % 7 as b, concat('/b', c_custkey % 7, '/', {_STEM}, '.java') as file from customer),
    r as (select path, file, 0 as k, 'query path' as rule from q join j on c % 5 = 0 and (c % 150 = s or c % 31 = s)
      union select path, concat('/k/C', p % 40, '.java'), 1, 'config' from q join (select p_partkey as p from part where p_partkey % 20 = 0) on p % 120 = s where p % 40 < 30
      union select path, concat('/k/C', p % 29, '.java'), 1, 'config' from q join (select p_partkey as p from part where p_partkey % 35 = 0) on p % 110 = s
      union select path, file, 2, 'name' from q join j on j.b = s % 7 and c < 300 and c % 100 = s and c % 3 < 2)
    select path, file, rules, first_rule from q left join (select path, file, string_agg(rule, ', ' order by k) as rules, arg_min(rule, k) as first_rule from r group by path, file) using (path)"""
)
def batch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Java files of all suppliers' query files, by calls, by the configs of all parts and by name."""
    made = lambda sql, name: spark.sql(sql, **{name: table(spark, sf_dir, name)})
    return discover.batch_sources(made(_BATCHES, "supplier"), made(_JAVA, "customer"), made(_CONFIGS, "part"), made(_CLASSES, "customer"))


_NESTED = r"""select concat('q', o_orderkey) as sql_id, case o_orderkey % 5
  when 0 then concat('SELECT a.X', o_custkey, ' AS OUT_A, b.TOTAL /* , gone */ FROM (SELECT t.CUST_NM AS X', o_custkey, ', NVL(t.AMT, (0)) AMT2 FROM SALES.CUSTOMER t) a, (SELECT SUM(AMT2) TOTAL, KEY FROM (SELECT o.AMT AS AMT2, o.KEY FROM ORDERS o WHERE o.Z IN (SELECT JUMIN_NO FROM ZZ)) i GROUP BY KEY) b WHERE a.K = b.K')
  when 1 then concat('select * from (select c.jumin_no as no_', o_custkey, ', c.* from cust c) z')
  when 2 then concat('SELECT CUST_NM, JUMIN_NO || \'-, (\' || X', o_custkey, ' AS MIXED FROM CUST')
  when 3 then concat('SELECT p.NM AS N1, p.AMT FROM P p UNION ALL SELECT q.CUST_NM, MAX(q.V', o_custkey, ') FROM Q q LEFT OUTER JOIN R r ON q.A = r.A')
  else 'UPDATE CUST SET CUST_NM = (SELECT JUMIN_NO FROM T)' end as sql from {orders}"""


@query(
    """with k as (select concat('q', o_orderkey) as sql_id, o_orderkey % 5 as m, o_custkey as c from orders)
    select sql_id, 'OUT_A' as name, 'CUSTOMER' as table_name, 'CUST_NM' as "column" from k where m = 0 union all select sql_id, 'TOTAL', 'ORDERS', 'AMT' from k where m = 0
    union all select sql_id, concat('NO_', c), 'CUST', 'JUMIN_NO' from k where m = 1 union all select sql_id, '*', 'CUST', '*' from k where m = 1
    union all select sql_id, 'CUST_NM', 'CUST', 'CUST_NM' from k where m = 2 union all select sql_id, 'MIXED', 'CUST', 'JUMIN_NO' from k where m = 2 union all select sql_id, 'MIXED', 'CUST', concat('X', c) from k where m = 2
    union all select sql_id, 'N1', 'P', 'NM' from k where m = 3 union all select sql_id, 'N1', 'Q', 'CUST_NM' from k where m = 3 union all select sql_id, 'AMT', 'P', 'AMT' from k where m = 3 union all select sql_id, 'AMT', 'Q', concat('V', c) from k where m = 3"""
)
def column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table columns of the result columns of a nested statement of every order."""
    return lineage.columns(spark.sql(_NESTED, orders=spread(table(spark, sf_dir, "orders"))))


@query(
    """with k as (select concat('q', o_orderkey) as sql_id, o_orderkey % 5 as m, o_custkey as c from orders), f as (select sql_id, m, unnest(['OUT_A', 'no_' || c, 'mixed', 'N1', 'CUST_NM', 'OTHER']) as col from k)
    select sql_id, concat('f', lower(col)) as java_field, col as "column", case when m = 0 and col = 'OUT_A' or m = 3 and col = 'N1' or m = 2 and col = 'CUST_NM' then 'CUST_NM' when m = 1 and col like 'no%' or m = 2 and col = 'mixed' then 'JUMIN_NO' end as original,
      case when m = 0 and col = 'OUT_A' then 'CUSTOMER' when m = 3 and col = 'N1' then 'Q' when m = 2 and col in ('CUST_NM', 'mixed') or m = 1 and col like 'no%' then 'CUST' end as table_name
    from f where m = 0 and col = 'OUT_A' or m = 1 and col like 'no%' or m = 2 and col = 'mixed' or m = 3 and col = 'N1' or col = 'CUST_NM'"""
)
def field_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every order's result map that come from watched columns."""
    orders = table(spark, sf_dir, "orders")
    fields = orders.select(F.expr("concat('q', o_orderkey)").alias("sql_id"), F.explode(F.expr("array('OUT_A', concat('no_', o_custkey), 'mixed', 'N1', 'CUST_NM', 'OTHER')")).alias("column"))
    targets = table(spark, sf_dir, "region").selectExpr("case r_regionkey when 0 then 'cust_nm' when 1 then 'JUMIN_NO' else concat('NEVER', r_regionkey) end as column")
    return lineage.field_columns(spark.sql(_NESTED, orders=spread(orders)), fields.withColumn("java_field", F.concat(F.lit("f"), F.lower("column"))), targets)
