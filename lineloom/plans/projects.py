"""Registered queries over whole projects: dialects of SQL files, files of statements, service chains, proposed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patching, reports, resolve
from ..sources import batchsql
from .catalog import query, table

_ENDS = "case p_partkey % 8 when 0 then 'Mapper.xml' when 1 then 'dqm.xml' when 2 then 'Bat_SQL.xml' when 3 then '_sql.xml' when 4 then 'Dem.java' when 5 then '.java' when 6 then 'Dqm.java' else 'Mapper.XML' end"
_FILES = f"select p_partkey, concat('src/', replace(p_type, ' ', ''), {_ENDS}) as path, case when p_size % 3 = 0 then concat('// select ', p_name) when p_size % 3 = 1 then concat('@Entity ', p_name) end as text from {{part}}"


@query(
    f"""with f as ({_FILES.replace("{part}", "part")}) select p_partkey, dialect from f, (values ('mapper'), ('dqm'), ('bat_sql'), ('any_sql'), ('dem_dqm'), ('jdbc'), ('jpa')) as d(dialect) where case dialect
      when 'mapper' then regexp_matches(path, '(?i:mapper)[.]xml$') when 'dqm' then regexp_matches(path, '(?i:dqm)[.]xml$') when 'bat_sql' then regexp_matches(path, '(?i:bat_sql)[.]xml$')
      when 'any_sql' then regexp_matches(path, '_(?i:sql)[.]xml$') when 'dem_dqm' then regexp_matches(path, '(?i:dem|dqm)[.]java$')
      when 'jdbc' then regexp_matches(path, '[.]java$') and text ilike '%select %' else regexp_matches(path, '[.]java$') and text ilike '%@entity%' end"""
)
def sql_files_by_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(_FILES, part=table(spark, sf_dir, "part"))
    hits = F.array_compact(F.array(*(F.when(batchsql.is_sql_file(F.col("path"), F.col("text"), d), d) for d in [*batchsql.BY_NAME, *batchsql.BY_TEXT])))
    return f.select("p_partkey", F.explode(hits).alias("dialect"))


_QUERY_FILES = "select concat('/b', s_nationkey, '/Job', s_suppkey, case when s_suppkey % 5 = 0 then '_sql.xml' else '_SQL.xml' end) as path from {supplier}"
_JAVA_FILES = """select concat('/b', c_nationkey, case when c_custkey % 4 = 0 then '/batVO/x' else '' end, '/', case c_custkey % 3 when 0 then 'Job' when 1 then 'JOB' else 'jOb' end, c_custkey % 90, '.java') as path from {customer}
union all select concat('/b', n_nationkey, '/Job', n_nationkey, '.xml') from {nation}"""


@query(
    rf"""with q as (select distinct path, regexp_extract(path, '^(/[^/]*)/', 1) as folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)_sql[.]xml$', '') as base from ({_QUERY_FILES.replace("{supplier}", "supplier")})),
    j as (select distinct path as file, regexp_extract(path, '^(.*)/', 1) as folder, regexp_extract(path, '([^/]*)[.]java$', 1) as stem from ({_JAVA_FILES.replace("{customer}", "customer").replace("{nation}", "nation")}) where path like '%.java'),
    c as (select q.path, file, row_number() over (partition by q.path order by case when q.folder <> j.folder then 3 when stem = base then 0 when stem = upper(base) then 1 when stem = lower(base) then 2 else 3 end, file) as n
      from q join j on lower(stem) = lower(base))
    select path, 'bat' as layer, file from c where n = 1 union all select q.path, 'batvo', file from q join j on starts_with(lower(file), lower(q.folder) || '/') where file ilike '%batvo%'"""
)
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    java = spark.sql(_JAVA_FILES, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    return batchsql.batch_files(spark.sql(_QUERY_FILES, supplier=table(spark, sf_dir, "supplier")), java)


_SERVICES = """select concat('svc/N', n_nationkey, case when n_nationkey % 3 = 0 then '' when n_nationkey % 3 = 1 then 'Impl' else 'IMPL' end, '.java') as path,
  array(concat('a.b.IN', (n_nationkey * 2 + 1) % 25), concat('a.b.N', n_nationkey * 3 % 25), 'java.util.List') as imports from {nation}"""
_CONTROLS = "select concat('ctl/S', s_suppkey, '.java') as path, array(concat('x.IN', s_nationkey), 'x.INone') as imports from {supplier}"


@query(
    """with recursive f as (select n_nationkey as k, concat('svc/N', n_nationkey, case n_nationkey % 3 when 0 then '' when 1 then 'Impl' else 'IMPL' end, '.java') as file from nation),
    e as (select n_nationkey as a, (n_nationkey * 2 + 1) % 25 as b from nation union select n_nationkey, n_nationkey * 3 % 25 from nation),
    r as (select concat('ctl/S', s_suppkey, '.java') as root, s_nationkey as k, 1 as depth from supplier union select root, b, depth + 1 from r join e on e.a = r.k where depth < 25)
    select root, file, min(depth) as depth from r join f using (k) group by root, file"""
)
def service_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = spark.sql(_SERVICES, nation=table(spark, sf_dir, "nation"))
    controls = spark.sql(_CONTROLS, supplier=table(spark, sf_dir, "supplier"))
    return resolve.service_chain(services.unionByName(controls), services.select("path"), controls.select("path"))


# --- endpoints of other frameworks, chains and groups of files ---------------------------------------------------------


_IMPORTS = "select concat('N', n_nationkey) as path, concat('N', (n_nationkey * 2 + 1) % 25) as imported from {nation} union all select concat('N', n_nationkey), concat('N', n_nationkey * 3 % 25) from {nation} union all select concat('N', n_nationkey), concat('T', n_nationkey) from {nation} where n_regionkey = 0"


@query(
    """with recursive e as (select n_nationkey as a, (n_nationkey * 2 + 1) % 25 as b from nation union select n_nationkey, n_nationkey * 3 % 25 from nation),
    r as (select n_nationkey as root, n_nationkey as k, 0 as depth, concat('N', n_nationkey) as chain from nation union all
      select root, b, depth + 1, chain || '>N' || b from r join e on e.a = r.k where depth < 6 and not list_contains(string_split(chain, '>'), concat('N', b))),
    u as (select root, depth, chain from r where k in (select n_nationkey from nation where n_regionkey = 0))
    select concat('N', root) as root, arg_min(chain, (depth, string_split(chain, '>'))) as chain from u group by root"""
)
def chains_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    edges = spark.sql(_IMPORTS, nation=nation)
    got = resolve.chains_to(edges, edges.select("path"), edges.where("imported like 'T%'").select(F.col("imported").alias("path")))
    return got.select("root", F.array_join("chain", ">").alias("chain"))


_NEAR = "select concat('p', s_nationkey, '/S', s_suppkey, '.java') as path, concat('use(S', s_suppkey + 25, '); new S', s_suppkey, '(); XS', s_suppkey + 50, ' // ', s_name) as text from {supplier}"


@query("select concat('p', a.s_nationkey, '/S', a.s_suppkey, '.java') as path, concat('p', b.s_nationkey, '/S', b.s_suppkey, '.java') as imported from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 25 and b.s_nationkey = a.s_nationkey")
def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(_NEAR, supplier=table(spark, sf_dir, "supplier"))
    return resolve.package_edges(f, f)


# --- report lookups -------------------------------------------------------------------------------------------------

_CLASSES = "select concat('C', c_nationkey) as class_name from {customer}"
_ACCESS = "select concat('C', s_nationkey) as class_name, concat('acc/', s_suppkey, '/C', s_nationkey, '.java') as path, s_suppkey as ord from {supplier} where s_suppkey % 3 = 0"
_PROJECT = "select concat('m', c_custkey % 7, '/C', c_custkey % 40, case when c_custkey % 11 = 0 then '.xml' else '.java' end) as path from {customer} where c_nationkey < 12"


@query(
    """with k as (select concat('C', s_nationkey) as class_name, arg_max(concat('acc/', s_suppkey, '/C', s_nationkey, '.java'), s_suppkey) as k from supplier where s_suppkey % 3 = 0 group by 1),
    f as (select concat('C', c_custkey % 40) as class_name, min(concat('m', c_custkey % 7, '/C', c_custkey % 40, '.java')) as f from customer where c_nationkey < 12 and c_custkey % 11 <> 0 group by 1)
    select c.class_name, coalesce(k, f) as path from (select distinct concat('C', c_nationkey) as class_name from customer) c left join k using (class_name) left join f using (class_name)"""
)
def class_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return reports.class_paths(spark.sql(_CLASSES, customer=customer), spark.sql(_ACCESS, supplier=supplier), spark.sql(_PROJECT, customer=customer))


_STACKS = "select array(concat('C', o_custkey, '.f'), concat('O', o_custkey % 9, '.', o_orderpriority), concat('C', o_custkey + 1, '.', o_orderstatus, '.x'), 'plain') as stack from {orders}"


@query(
    """with f as (select distinct concat('C', c_custkey) as stem from customer where c_custkey % 3 > 0), s as (select distinct o_custkey as k, o_orderstatus as st from orders where concat('C', o_custkey) in (select stem from f))
    select distinct concat('src/', stem, '.java') as path, method from f join (select concat('C', k) as stem, 'f' as method from s union all select concat('C', k + 1), concat(st, '.x') from s) using (stem)"""
)
def stack_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("src/C"), "c_custkey", F.lit(".java")).alias("path"))
    return reports.stack_methods(spark.sql(_STACKS, orders=table(spark, sf_dir, "orders")), files)


# --- proposed changes -----------------------------------------------------------------------------------------------


_ANSWERS = """select conv_id, turn, concat('said\n======FILE======\n A', turn, '.java \n======REASON======\n', coalesce(text, ''), '\n======MODIFIED_CODE======\nclass A {{ }}\n======END======\n',
  case when turn % 2 = 0 then '======FILE======\nB.java\n======END======' else 'rest' end) as answer from {conversations}"""


@query(
    """select conv_id, turn, 0 as place, concat('A', turn, '.java') as name, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as reason, 'class A { }' as code from conversations
    union all select conv_id, turn, 1, 'B.java', '', '' from conversations where turn % 2 = 0"""
)
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_ANSWERS, conversations=table(spark, sf_dir, "conversations"))
    return patching.answers(df, "answer").select("conv_id", "turn", "place", "change.*")
