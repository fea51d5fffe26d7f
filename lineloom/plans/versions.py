"""Registered queries over versions of Java files and statements built in them; the files are made of rows of the given tables.

The SQL twins don't read the files: what must come out is worked out from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, builders, methods, specs
from ..sources import javaparse
from .catalog import query, spread, table

#: A file of each part, before and after: heads with blanks, braces in literals and comments, overloads, methods that come, go and move.
_OLD = r"""concat_ws('\n', concat('class P', p_partkey, ' {'), '  // { not a block', '  public String keep() {', concat('    return "}{" + ', p_partkey, ';'), '  }',
  '  protected int alt(int a) {', concat('    return a + ', p_partkey, ';'), '  }', '  protected int alt(int a, int b) {', '    if (a > b) {', '      return a;', '    }', '    return b;', '  }',
  case when p_partkey % 3 = 0 then '  public void gone() {\n    run();\n  }' end, case when p_partkey % 5 = 1 then concat('  static void wander', p_partkey, '() { stay(); }') end, '}')"""
_NEW = r"""concat_ws('\n', concat('class P', p_partkey, ' {'), '  // { not a block', '  public String keep()   {', concat('      return "}{" + ', p_partkey, ';'), '  }',
  case when p_partkey % 7 = 0 then '  public void fresh() {\n    /* } */ start();\n  }' end,
  '  protected int alt(int a) {', concat('    return a ', case when p_partkey % 4 = 0 then '-' else '+' end, ' ', p_partkey, ';'), '  }', '  protected int alt(int a, int b) {', '    if (a > b) {',
  case when p_partkey % 6 = 0 then '      return a + 1;' else '      return a;' end, '    }', '    return b;', '  }', '}')"""
_SAME = "concat('src/P', p_partkey, '.java')"
_OTHER = "concat('src/W', p_partkey, '.java')"
_MOVED = r"concat('class W {\n  static void wander', p_partkey, '() { stay(); }\n}')"


def old_files(part: DataFrame) -> DataFrame:
    return spread(part).select(F.expr(_SAME).alias("path"), F.expr(_OLD).alias("text"))


def new_files(part: DataFrame) -> DataFrame:
    return spread(part).select(F.expr(_SAME).alias("path"), F.expr(_NEW).alias("text")).unionByName(spread(part.where("p_partkey % 5 = 1")).select(F.expr(_OTHER).alias("path"), F.expr(_MOVED).alias("text")))


@query(
    f"""with k as (select p_partkey as k, {_SAME} as p, {_OTHER} as w, case when p_partkey % 7 = 0 then 3 else 0 end as o, case when p_partkey % 3 = 0 then 3 else 0 end as g from part)
    select path, name, nth, status, cast(a as int) as old_start, cast(b as int) as old_end, cast(c as int) as "start", cast(d as int) as "end", other_path from (
      select p as path, 'keep' as name, 1 as nth, 'same' as status, 3 as a, 5 as b, 3 as c, 5 as d, null as other_path from k
      union all select p, 'alt', 1, case when k % 4 = 0 then 'changed' else 'same' end, 6, 8, 6 + o, 8 + o, null from k
      union all select p, 'alt', 2, case when k % 6 = 0 then 'changed' else 'same' end, 9, 14, 9 + o, 14 + o, null from k
      union all select p, 'gone', 1, 'removed', 15, 17, null, null, null from k where g = 3
      union all select p, 'fresh', 1, 'added', null, null, 6, 8, null from k where o = 3
      union all select p, concat('wander', k), 1, 'moved', 15 + g, 15 + g, null, null, w from k where k % 5 = 1
      union all select w, concat('wander', k), 1, 'moved', null, null, 2, 2, p from k where k % 5 = 1)"""
)
def method_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each method between two versions of the files of all parts."""
    part = table(spark, sf_dir, "part")
    return methods.changes(old_files(part), new_files(part))


@query(
    f"""with k as (select p_partkey as k, {_SAME} as path, case when p_partkey % 7 = 0 then 3 else 0 end as o from part),
    l as (select distinct l_partkey as k, 1 + (cast(l_quantity as int) + l_linenumber) % 20 as line from lineitem)
    select path, line, case when line between 3 and 5 then 'keep' when o = 3 and line between 6 and 8 then 'fresh' when line between 6 + o and 14 + o then 'alt' end as name from l join k using (k)"""
)
def methods_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method that holds each changed line: lines of all line items, in the files of their parts."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").select(F.expr("concat('src/P', l_partkey, '.java')").alias("path"), F.expr("1 + (cast(l_quantity as int) + l_linenumber) % 20").alias("line"))
    return methods.of_lines(lines, new_files(part))


#: A file of each customer whose methods build statements in variables of one name, chained, redeclared, unused, in comments and literals.
_DAO = r"""concat_ws('\n', 'package a.b;', concat('class Dao', c_custkey, ' {'), concat('  List<Vo', c_custkey % 7, '> find(int n, Key', c_custkey % 3, ' key) {'),
  '    // StringBuilder sql = new StringBuilder();', '    StringBuilder sql = new StringBuilder();', concat('    sql.append("SELECT c', c_custkey, ' ").append("FROM t");'),
  '    log("sql.append(\\"no\\")"); /* sql.append("gone") */', '    sql', '      .append(" WHERE a = \'x\'\\n").append(other);', '    return run(sql.toString());', '  }',
  '  void save(int a) {', '    StringBuilder sql = new StringBuilder();', '    sql.append("update t set a = \\"").append("q\\"");',
  case when c_custkey % 2 = 1 then '    StringBuilder mySQL = new StringBuilder( );\n    mySql.append("delete from u"); sql.append("!");\n    run(mySQL.toString());' end, '    run(sql.toString());',
  case when c_custkey % 3 = 0 then '    { StringBuilder sql = new StringBuilder(); sql.append("call p"); run(sql.toString()); }' end, '  }',
  '  void none() { StringBuilder sql = new StringBuilder(); sql.append("never"); }', '  void empty() { StringBuilder sql = new StringBuilder(); run(sql.toString()); }', '}')"""


def dao_files(customer: DataFrame) -> DataFrame:
    return spread(customer).select(F.expr("concat('dao/Dao', c_custkey, '.java')").alias("path"), F.expr(_DAO).alias("text"))


def value_files(nation: DataFrame) -> DataFrame:
    """Classes of every second nation, and one key class."""
    return nation.where("n_nationkey % 2 = 0").select(F.expr("concat('vo/Vo', n_nationkey, '.java')").alias("path"), F.expr("concat('package v.o; class ', if(n_nationkey = 8, 'Key1', concat('Vo', n_nationkey)), ' {}')").alias("text"))


@query(
    """with k as (select c_custkey as k, concat('dao/Dao', c_custkey, '.java') as path, concat('Dao', c_custkey) as class_name from customer),
    v as (select case when n_nationkey = 8 then 'Key1' else concat('Vo', n_nationkey) end as c from nation where n_nationkey % 2 = 0)
    select path, class_name, 'find' as method, 5 as line, 'SELECT' as query_type, concat('SELECT c', k, ' FROM t WHERE a = ''x''') as sql,
      (select concat('v.o.', c) from v where c = concat('Key', k % 3)) as parameter_type, (select concat('v.o.', c) from v where c = concat('Vo', k % 7)) as result_type from k
    union all select path, class_name, 'save', 13, 'UPDATE', concat('update t set a = "q"', case when k % 2 = 1 then '!' else '' end), null, null from k
    union all select path, class_name, 'save', 15, 'DELETE', 'delete from u', null, null from k where k % 2 = 1
    union all select path, class_name, 'save', 16 + case when k % 2 = 1 then 3 else 0 end, 'SELECT', 'call p', null, null from k where k % 3 = 0"""
)
def built_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that the methods of the files of all customers build in variables."""
    sources = dao_files(table(spark, sf_dir, "customer"))
    known = javaparse.types(sources.unionByName(value_files(table(spark, sf_dir, "nation"))))
    return builders.statements(sources, javaparse.methods(known), known)


#: Lines of a text with comment marks, heads, blanks and closing marks put in by line number and id.
_MARKED = """case (n * 7 + doc_id) % 11 when 0 then concat('/* ', t) when 1 then concat(t, ' */') when 2 then concat('// ', t) when 3 then '' when 4 then '  } */ );' when 5 then concat('/** ', t)
  when 6 then concat('public void m', n, '(int a) { // ', t) when 7 then concat(' * "', t, '" /* x */ y') when 8 then concat('call("/*"); ', t, ' /*') else t end"""
_CHANGED = "(n * 5 + doc_id) % 7 < 4"


@query(
    rf"""with recursive raw as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents where text is not null),
    l as (select doc_id, cast(n as int) as line, {_MARKED} as text, {_CHANGED} as changed from raw),
    m as (select *, contains(regexp_replace(text, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|//.*|/[*].*?[*]/', ' ', 'g'), '/*') as a,
      contains(text, '*/') as shut, contains(regexp_replace(substr(text, strpos(text, '*/') + 2), '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|//.*|/[*].*?[*]/', ' ', 'g'), '/*') as b from l),
    s as (select doc_id, line, false as inside, case when a then true else false end as later from m where line = 1
      union all select m.doc_id, m.line, s.later, case when not s.later then m.a when m.shut then m.b else true end from s join m on m.doc_id = s.doc_id and m.line = s.line + 1),
    k as (select m.doc_id, m.line, text, changed, inside, regexp_replace(text, '\s', '', 'g') = '' as blank from m join s using (doc_id, line)),
    c as (select *, not blank and (inside or regexp_matches(text, '^\s*(?://|/[*]|[*])')) as comment, changed and (not blank or inside) as open from k),
    d as (select *, open and not coalesce(lag(open) over (partition by doc_id order by line), false) as begins,
      min(case when not blank and not comment then line end) over (partition by doc_id order by line rows between 1 following and unbounded following) as stop,
      max(case when regexp_matches(text, '\b(?:public|protected|private)\b[^=;]*[(]') then line end) over (partition by doc_id order by line) as head, max(line) over (partition by doc_id) as final from c),
    p as (select *, sum(case when begins then 1 else 0 end) over (partition by doc_id order by line) as piece from d),
    q as (select doc_id, piece, min(line) as a, coalesce(arg_max(coalesce(stop, -1), line), -1) as stop, max(final) as final, bool_and(comment) as comment,
      nullif(arg_min(case when inside then '' when ltrim(text) like '/**%' then 'javadoc' when ltrim(text) like '/*%' then 'block' when ltrim(text) like '//%' then 'line' else '' end, line), '') as style,
      bool_and(regexp_matches(text, '^[\s)\]}}*/;,.]+$')) as closer, arg_min(coalesce(head, -1), line) as head from p where open group by doc_id, piece),
    e as (select *, case when stop < 0 then final else stop - 1 end as z from q),
    f as (select *, case when lag(piece) over w is null then 1 when closer then 0 when comment and lag(comment) over w and style = lag(style) over w and lag(z) over w >= a - 1 then 0 else 1 end as new from e window w as (partition by doc_id order by piece)),
    g as (select *, sum(new) over (partition by doc_id order by piece) as block from f)
    select cast(doc_id as varchar) as path, min(a) as start_line, max(z) as end_line, count(*) as pieces, nullif(arg_min(coalesce(style, ''), piece), '') as style,
      (select trim(text) from l where l.doc_id = g.doc_id and l.line = arg_min(g.head, g.piece)) as title from g group by doc_id, block"""
)
def change_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of changed lines in the texts of all documents, with comment marks put in."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t")).withColumn("n", F.col("n") + 1)
    return blocks.change_blocks(raw.select(F.col("doc_id").cast("string").alias("path"), F.col("n").alias("line"), F.expr(_MARKED).alias("text"), F.expr(_CHANGED).alias("changed")))


#: A file of each part: a header javadoc, a class comment in one of three styles or none, methods with and without comments of their own.
_SPEC = r"""concat_ws('\n', case when p_partkey % 4 = 0 then concat('/**\n * ***\n * TITLE : Part ', p_partkey, '\n * author: ', p_brand, '\n * History\n *  first line\n *  ', p_name, ' 2020-01-0', p_partkey % 9 + 1, '\n * NOTE made 2021.02.03\n * plain\n */') end,
  'package a.b;', 'import x.Y;', '@Note(value = ")/** no */")',
  case p_partkey % 4 when 1 then concat('/* summary= Kept ', p_size, '\n TODO more */') when 2 then concat('// first\n  // AB ', p_partkey, '\n@Other') end,
  concat(case when p_partkey % 3 = 0 then 'public abstract ' else '' end, 'class C', p_partkey, case when p_partkey % 2 = 0 then ' extends Base' else '' end, case when p_partkey % 5 = 0 then ' implements I1, I2<T>' else '' end, ' {'),
  '  String s = "class X {";', case when p_partkey % 4 <> 3 then '  /** Gets it.\n   * 작성자 : me */' else '  /* not it */' end, '  @Override', concat('  public Map<String, Long> get', p_partkey, '(int a, String b) { return "/** */"; }'),
  case when p_partkey % 6 = 0 then '  /** lost */ int x = 1;' end, '  protected void put() throws E { }', '}')"""


def spec_files(part: DataFrame) -> DataFrame:
    return spread(part).select(F.expr("concat('src/C', p_partkey, '.java')").alias("path"), F.expr(_SPEC).alias("text"))


@query(
    """with k as (select p_partkey as k, p_size as z, concat('src/C', p_partkey, '.java') as path, p_brand as b, p_name as n from part)
    select path, 'class' as kind, concat('C', k) as name, case when k % 2 = 0 then 'Base' end as extends, case when k % 5 = 0 then 'I1, I2<T>' else '' end as implements, null as return_type, null as params,
      case k % 4 when 0 then 'javadoc' when 1 then 'block' when 2 then 'line' end as style from k
    union all select path, 'method', concat('get', k), null, '', 'Map<String, Long>', 'int a, String b', case when k % 4 <> 3 then 'javadoc' end from k
    union all select path, 'method', 'put', null, '', 'void', '', null from k"""
)
def class_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and methods of all parts' files, with the style of the comment of each."""
    found = specs.declarations(spec_files(table(spark, sf_dir, "part")))
    return found.select("path", "kind", "name", "extends", F.array_join("implements", ", ").alias("implements"), "return_type", "params", "style")


@query(
    """with k as (select p_partkey as k, p_size as z, concat('src/C', p_partkey, '.java') as path, p_brand as b, p_name as n from part), f as (
      select path, 'class' as kind, 0 as line, 'title' as field, concat('Part ', k) as value from k where k % 4 = 0 union all select path, 'class', 1, 'author', b from k where k % 4 = 0 union all select path, 'class', 1, 'body', concat('author: ', b) from k where k % 4 = 0
      union all select path, 'class', 2, 'body', 'History' from k where k % 4 = 0 union all select path, 'class', 3, 'history', 'first line' from k where k % 4 = 0 union all select path, 'class', 4, 'history', concat(n, ' 2020-01-0', k % 9 + 1) from k where k % 4 = 0
      union all select path, 'class', 5, 'date', '2021.02.03' from k where k % 4 = 0 union all select path, 'class', 5, 'tag', 'NOTE made 2021.02.03' from k where k % 4 = 0 union all select path, 'class', 5, 'body', 'NOTE made 2021.02.03' from k where k % 4 = 0 union all select path, 'class', 6, 'body', 'plain' from k where k % 4 = 0
      union all select path, 'class', 0, 'title', concat('Kept ', z) from k where k % 4 = 1 union all select path, 'class', 1, 'tag', 'TODO more' from k where k % 4 = 1 union all select path, 'class', 1, 'body', 'TODO more' from k where k % 4 = 1
      union all select path, 'class', 0, 'body', 'first' from k where k % 4 = 2 union all select path, 'class', 1, 'title', concat('AB ', k) from k where k % 4 = 2
      union all select path, 'method', 0, 'body', 'Gets it.' from k where k % 4 <> 3 union all select path, 'method', 1, 'title', '작성자 : me' from k where k % 4 <> 3 union all select path, 'method', 1, 'author', 'me' from k where k % 4 <> 3)
    select * from f"""
)
def spec_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the comments of all parts' classes and methods."""
    found = specs.declarations(spec_files(table(spark, sf_dir, "part")))
    return specs.comment_fields(found).join(found.select("path", "place", "kind"), ["path", "place"]).select("path", "kind", "line", "field", "value")
