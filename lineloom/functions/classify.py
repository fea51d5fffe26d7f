"""What classes, methods and types are, by names and annotations: ordered rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a layer, in the order in which they are tried.
BY_ANNOTATION = [("Controller", ["controller"]), ("Service", ["service"]), ("Mapper", ["mapper"]), ("Repository", ["repository"]), ("Entity", ["entity", "table"])]
BY_NAME = [("Controller", ["Controller"]), ("Service", ["Service"]), ("Repository", ["Repository", "DAO", "Dao"]), ("Mapper", ["Mapper"]), ("Entity", ["Entity", "Domain", "Model", "POJO"])]
BY_INTERFACE = [("Mapper", ["mapper"]), ("Repository", ["repository"])]
BY_PACKAGE = [("Controller", ["controller", "web", "api"]), ("Service", ["service", "business"]), ("Mapper", ["mapper", "mybatis"]), ("Repository", ["repository", "jpa"]), ("DAO", ["dao", "data"]), ("Entity", ["entity", "domain", "model", "beans"])]
BY_FIELD = [("Repository", ["entitymanager"]), ("Mapper", ["sqlsession"]), ("DAO", ["jdbctemplate", "datasource"])]
#: Parts of collection types, of names of paging parameters, of paging in SQL.
COLLECTIONS = ["list<", "collection<", "set<", "deque<", "queue<", "map<", "vector<", "stack<", "[]"]
PAGING = ["page", "paging", "pagenum", "pageno", "pagesize"]
SQL_PAGING = ["LIMIT", "OFFSET", "ROWNUM"]
OUT_WEIGHT = {"single": 1, "paged_list": 20, "unpaged_list": 100}


def holds(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(text.contains(w), F.lit(False))
    return out


def cascade(rules: list[tuple[str, Column]], otherwise: Column) -> Column:
    out = F.when(rules[0][1], rules[0][0])
    for name, test in rules[1:]:
        out = out.when(test, name)
    return out.otherwise(otherwise)


def layer(name: Column, package: Column, annotations: Column, interfaces: Column, field_types: Column) -> Column:
    """Layer of a class: annotations (of class and method) before name, interfaces, package and field types; else Unknown."""
    some = lambda many, words: F.coalesce(F.exists(many, lambda x: holds(F.lower(x), words)), F.lit(False))
    rules = [(k, some(annotations, w)) for k, w in BY_ANNOTATION] + [(k, holds(name, w)) for k, w in BY_NAME]
    rules += [(k, some(interfaces, w)) for k, w in BY_INTERFACE] + [(k, holds(F.lower(package), w)) for k, w in BY_PACKAGE]
    return cascade(rules + [(k, some(field_types, w)) for k, w in BY_FIELD], F.lit("Unknown"))


def layer_by_suffix(name: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Layer by the end of the class name, by ordered rules [(layer, suffixes)]; else Unknown."""
    tests = []
    for k, ends in rules:
        test = F.lit(False)
        for e in ends:
            test = test | name.endswith(e)
        tests.append((k, test))
    return cascade(tests, F.lit("Unknown"))


def program_type(name: Column, path: Column) -> Column:
    """Kind of program by class name or path; empty if neither tells."""
    n, p = F.lower(name), F.lower(path)
    either = lambda w: holds(n, [w]) | holds(p, [w])
    rules = [("Controller", either("controller")), ("serviceImpl", either("serviceimpl")), ("Service", either("service")), ("DAO", either("dao") | holds(n, ["repository"])), ("Mapper", either("mapper"))]
    return cascade(rules, F.lit(""))


def data_type(return_type: Column, params: Column, sql: Column) -> Column:
    """single, paged_list or unpaged_list: paging types and parameters, then collections, then what the SQL says.

    params: array of structs (type, name), may be null.
    """
    low = F.lower(return_type)
    name = lambda p: F.lower(p["name"])
    paged = F.lit(False)
    for w in PAGING:
        paged = paged | F.exists(params, lambda p: (name(p) == w) | name(p).startswith(f"{w}_") | name(p).contains(f"_{w}_"))
    paged = F.coalesce(paged | F.exists(params, lambda p: F.lower(p["type"]).contains("pageable")), F.lit(False))
    given = F.coalesce(return_type, F.lit("")) != ""
    by_sql = F.when(holds(F.upper(sql), SQL_PAGING), "paged_list").otherwise("single")
    return F.when(~given, by_sql).when(low.rlike(r"\bpage(list)?<") | paged, "paged_list").when(holds(low, COLLECTIONS), "unpaged_list").otherwise(by_sql)


def data_type_inline(return_type: Column, sql: Column) -> Column:
    """The other reading: fewer types count, and SQL only where the type is unknown."""
    low = F.lower(return_type)
    known = F.coalesce(return_type, F.lit("")) != ""
    return F.when(known & holds(low, ["page<", "pagelist"]), "paged_list").when(known & holds(low, ["list<", "collection<", "[]"]), "unpaged_list").when(~known & holds(F.upper(sql), SQL_PAGING), "paged_list").otherwise("single")


def input_weight(kind: Column) -> Column:
    return F.when(holds(F.lower(kind), ["multipart"]), 1000.0).otherwise(1.0)


def weight(in_count: Column, in_weight: Column, out_count: Column, data_type: Column, return_type: Column) -> Column:
    """in_count * in_weight + out_count * weight of the data type; what returns nothing has no output."""
    out = F.lit(0)
    for k, w in OUT_WEIGHT.items():
        out = F.when(data_type == k, w).otherwise(out)
    return in_count * in_weight + F.when(F.lower(return_type) == "void", 0).otherwise(out_count * out)


def simple_type(kind: Column) -> Column:
    """A type without arguments; of nested ones, what stands before the first."""
    return F.trim(F.substring_index(kind, "<", 1))


def json_object(text: Column) -> Column:
    """The JSON object in free text: a fenced block's, else from the first brace to the last; null if it doesn't parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # trailing commas are put right
    fixed = F.regexp_replace(F.when(fenced != "", fenced).otherwise(bare), r",(\s*[}\]])", "$1")
    return F.when(F.try_parse_json(fixed).isNotNull(), fixed)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def token_size(text: Column) -> Column:
    """Tokens of a text by the rule of four characters; null has none."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def for_sheet(text: Column) -> Column:
    """Text for a spreadsheet cell: without control characters that XML forbids, a leading sign quoted."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(clean.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)
