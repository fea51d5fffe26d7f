"""What SQL statements refer to, as Column expressions: tables, columns, verbs, parameters, aliases, join edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of SQL after which a table stands.
BEFORE_TABLE = ("FROM", "JOIN", "UPDATE")


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, however often the body names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_comments(sql: Column) -> Column:
    """Block and line comments out, white space single; what looks like a comment inside a string stays."""
    # a mark after each string and in place of each comment; a string loses its mark, a comment becomes a blank
    marked = F.regexp_replace(sql, r"(?s)('(?:[^']|'')*'|\"[^\"]*\")|/\*.*?\*/|--[^\n]*", "$1\x01")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, "(['\"])\x01", "$1"), "\x01", " "), r"\s+", " "))


def _tables(sql: Column) -> Column:
    """Names as they stand after a word of BEFORE_TABLE, or after INSERT INTO; the statement is read as words and signs."""
    words = all_of(sql, r"[A-Za-z_][\w.]*+|\S", 0)
    back = lambda w, i, n: F.upper(F.when(i >= n, F.get(w, i - n)))
    after = lambda w, i: back(w, i, 1).isin(*BEFORE_TABLE) | ((back(w, i, 1) == "INTO") & (back(w, i, 2) == "INSERT"))
    return let(words, lambda w: F.array_compact(F.transform(w, lambda x, i: F.when(x.rlike("^[A-Za-z_]") & after(w, i), x))))


def table_names(sql: Column) -> Column:
    """Upper-case table names without schema, sorted."""
    return F.array_sort(F.array_distinct(F.transform(_tables(sql), lambda x: F.upper(F.substring_index(x, ".", -1)))))


def qualified_tables(sql: Column) -> Column:
    """The other reading: lower case, schema kept, sorted."""
    return F.array_sort(F.array_distinct(F.transform(_tables(sql), F.lower)))


def query_type(sql: Column) -> Column:
    head = F.upper(F.regexp_extract(without_comments(sql), r"^(\w+)", 1))
    return F.when(head.isin("SELECT", "INSERT", "UPDATE", "DELETE"), head)


def parameters(sql: Column) -> Column:
    """#{x} and ${x} of simple identifiers, sorted."""
    return F.array_sort(F.array_distinct(F.concat(all_of(sql, r"#\{(\w+)\}"), all_of(sql, r"\$\{(\w+)\}"))))


def column_names(sql: Column, table: Column) -> Column:
    """Columns that a statement uses of a table: unqualified names of the first select list, names qualified by the
    table or its alias, the INSERT list and the left sides of SET; upper case, sorted. '*' is no column."""
    select = F.regexp_extract(sql, r"(?is)\bSELECT\s+(.*?)\s+FROM\b", 1)
    items = F.transform(F.split(select, ","), lambda x: F.trim(x))
    plain = F.filter(F.transform(items, lambda x: F.regexp_extract(x, r"^([A-Za-z_]\w*)", 1)), lambda x: x != "")
    qualified = F.transform(F.filter(items, lambda x: x.rlike(r"^\w+\.\w+")), lambda x: x)
    refs = F.filter(all_of(sql, r"(?i)\b(?:FROM|JOIN|UPDATE)\s+([\w.]+\s+(?:AS\s+)?\w+)"), lambda x: F.upper(F.substring_index(F.regexp_extract(x, r"^([\w.]+)", 1), ".", -1)) == F.upper(table))
    aliases = F.transform(refs, lambda x: F.regexp_extract(x, r"(\w+)$", 1))
    own = let(aliases, lambda a: F.transform(F.filter(qualified, lambda x: F.lower(F.substring_index(x, ".", 1)).eqNullSafe(F.lower(table)) | F.array_contains(a, F.substring_index(x, ".", 1))), lambda x: F.regexp_extract(x, r"^\w+\.(\w+)", 1)))
    bare = let(qualified, lambda many: F.filter(plain, lambda x: ~F.exists(many, lambda q: F.substring_index(q, ".", 1) == x)))
    inserted = F.filter(F.transform(F.split(F.regexp_extract(sql, r"(?is)INSERT\s+INTO\s+[\w.]+\s*\(([^)]*)\)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    updated = all_of(F.regexp_extract(sql, r"(?is)\bSET\s+(.*?)(?:\bWHERE\b|$)", 1), r"(\w+)\s*=")
    return F.array_sort(F.array_distinct(F.transform(F.concat(bare, own, inserted, updated), F.upper)))


def join_edges(statements: DataFrame) -> DataFrame:
    """(sql_id, join_type, left_table, left_column, right_table, right_column) of ON a.x = b.y, aliases resolved; a bare JOIN is INNER."""
    base = statements.select("sql_id", without_comments(F.col("sql")).alias("sql"))
    refs = base.select("sql_id", F.explode(all_of(F.col("sql"), r"(?i)\b(?:FROM|JOIN)\s+([\w.]+(?:\s+(?:AS\s+)?\w+)?)")).alias("ref"))
    table = F.upper(F.substring_index(F.regexp_extract("ref", r"^([\w.]+)", 1), ".", -1))
    second = F.regexp_extract("ref", r"(?i)^[\w.]+\s+(?:AS\s+)?(\w+)$", 1)
    alias = F.when(F.upper(second).isin("", "WHERE", "ON", "SET", "INNER", "LEFT", "RIGHT", "FULL", "JOIN", "ORDER", "GROUP"), table).otherwise(F.upper(second))
    names = refs.select("sql_id", table.alias("table_name"), alias.alias("alias")).distinct()
    pattern = r"(?i)((?:LEFT|RIGHT|FULL|INNER|CROSS)?\s*(?:OUTER\s+)?JOIN\s+[\w.]+(?:\s+(?:AS\s+)?\w+)?\s+ON\s+\w+\.\w+\s*=\s*\w+\.\w+)"
    j = base.select("sql_id", F.explode(all_of(F.col("sql"), pattern)).alias("j"))
    kind = F.upper(F.regexp_extract("j", r"(?i)^(LEFT|RIGHT|FULL|INNER|CROSS)", 1))
    on = lambda i: F.regexp_extract("j", r"(?i)\sON\s+(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)", i)
    e = j.select("sql_id", F.when(kind == "", "INNER").otherwise(kind).alias("join_type"), F.upper(on(1)).alias("la"), F.upper(on(2)).alias("left_column"), F.upper(on(3)).alias("ra"), F.upper(on(4)).alias("right_column"))
    e = e.join(names.select("sql_id", F.col("alias").alias("la"), F.col("table_name").alias("left_table")), ["sql_id", "la"])
    e = e.join(names.select("sql_id", F.col("alias").alias("ra"), F.col("table_name").alias("right_table")), ["sql_id", "ra"])
    return e.select("sql_id", "join_type", "left_table", "left_column", "right_table", "right_column").distinct()


def select_items(sql: Column) -> Column:
    """Items of the outermost SELECT list, as (column, alias) structs; commas and FROMs in brackets or strings don't count.

    `x AS a` and `x a` have an alias; the column is the last name of a plain reference, null for an expression. A fold over the
    statement's tokens.
    """
    tokens = F.regexp_extract_all(without_comments(sql), F.lit(r"(?s)'(?:[^']|'')*'|\w+|\s+|."), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("part"), F.lit("").alias("item"), F.expr("cast(array() as array<string>)").alias("items"))

    def step(a, t):
        up = F.upper(t)
        top = a["depth"] == 0
        begins, ends = top & (a["part"] == 0) & (up == "SELECT"), top & (a["part"] == 1) & (up == "FROM")
        comma = top & (a["part"] == 1) & (t == ",")
        done = F.array_append(a["items"], F.trim(a["item"]))
        return F.struct(
            (a["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
            F.when(begins, 1).when(ends, 2).otherwise(a["part"]).alias("part"),
            F.when(begins | ends | comma, F.lit("")).when(a["part"] == 1, F.concat(a["item"], t)).otherwise(a["item"]).alias("item"),
            F.when(comma | ends, done).otherwise(a["items"]).alias("items"),
        )

    folded = F.aggregate(tokens, start, step, lambda a: F.when(a["part"] == 1, F.array_append(a["items"], F.trim(a["item"]))).otherwise(a["items"]))

    def parsed(x):
        x = F.regexp_replace(x, r"(?i)^(?:DISTINCT|ALL)\s+", "")
        alias = F.regexp_extract(x, r"(?is)^.*[\w)'\"]\s+(?:AS\s+)?(\w+)$", 1)
        body = F.when(alias != "", F.regexp_replace(x, r"(?is)\s+(?:AS\s+)?\w+$", "")).otherwise(x)
        return F.struct(F.nullif(F.regexp_extract(body, r"^(?:\w+\.)*(\w+)$", 1), F.lit("")).alias("column"), F.nullif(alias, F.lit("")).alias("alias"), body.alias("expression"))

    return F.transform(F.filter(folded, lambda x: x != ""), parsed)


def plain_columns(sql: Column) -> Column:
    """The other reading of a SELECT list: its plain names, without qualifier, sorted; expressions and * are left out."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(select_items(sql), lambda x: x["column"].isNotNull()), lambda x: x["column"])))


def columns_by_alias(sql: Column, targets: Column) -> Column:
    """(column, alias) of SELECT items in which a target column stands as a word; without an alias the column's own name."""
    items = F.transform(select_items(sql), lambda x: F.struct(F.get(F.filter(targets, lambda t: F.regexp_like(F.lower(x["expression"]), F.concat(F.lit(r"\b"), F.lower(t), F.lit(r"\b")))), F.lit(0)).alias("column"), x["alias"].alias("alias")))
    return F.transform(F.filter(items, lambda x: x["column"].isNotNull()), lambda x: F.struct(x["column"].alias("column"), F.coalesce(x["alias"], x["column"]).alias("alias")))
