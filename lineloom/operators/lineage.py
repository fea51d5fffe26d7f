"""Where the columns of statements come from: relations of nested selects, composed to base tables, met with result maps."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.sqltext import all_of

#: Words of expressions that are no columns.
_WORDS = ("CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "NULL", "IS", "IN", "LIKE", "BETWEEN", "AS", "DISTINCT", "ASC", "DESC", "OVER", "PARTITION", "BY", "ORDER")
_GROUP = r"\([^()]*\)"
_SELECT = r"(?is)^\(\s*SELECT\b"


def depth(sql: Column) -> Column:
    """How deep brackets are nested."""
    marks = all_of(sql, r"[()]", 0)
    at = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, m: F.struct((s["now"] + F.when(m == "(", 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(m == "(", 1).otherwise(-1)).alias("most")))
    return at["most"]


def scopes(statements: DataFrame) -> tuple[DataFrame, int]:
    """(sql_id, scope, text) of every select of statements (sql_id, sql), and the largest depth; the outermost scope is #.

    Innermost brackets go first: a select becomes a row and a name in its place, other brackets are turned into braces, so that what is
    left at last has commas between its items alone.
    """
    plain = statements.where(F.col("sql").isNotNull()).select("sql_id", F.regexp_replace(sqltext.without_comments(F.col("sql")), r"'(?:[^']|'')*'", "0").alias("text"))
    most = plain.agg(F.max(depth(F.col("text")))).first()[0] or 0
    found = []
    for level in range(most):
        tokens = all_of(F.col("text"), rf"{_GROUP}|[^()]++|[()]", 0)
        named = F.transform(tokens, lambda x, i: F.when(x.rlike(_SELECT), F.struct(F.concat(F.lit(f"#{level}_"), i.cast("string")).alias("scope"), F.substring(x, F.lit(2), F.length(x) - 2).alias("inner"))))  # noqa: B023
        rows = plain.select("sql_id", F.explode(F.array_compact(named)).alias("x"))
        found.append(rows.select("sql_id", "x.scope", F.col("x.inner").alias("text")))
        left = F.transform(tokens, lambda x, i: F.when(x.rlike(_SELECT), F.concat(F.lit(f" #{level}_"), i.cast("string"), F.lit(" "))).when(x.rlike(rf"(?s)^{_GROUP}$"), F.translate(x, "(),", "{};")).otherwise(x))  # noqa: B023
        plain = plain.select("sql_id", F.array_join(left, "").alias("text"))
    root = plain.where(F.col("text").rlike(r"(?is)^\s*(?:#|SELECT\b)")).select("sql_id", F.lit("#").alias("scope"), "text")
    return reduce(DataFrame.unionByName, found, root), most


def relations(found: DataFrame) -> DataFrame:
    """(sql_id, scope, name, source, column) of scopes(): the column of a source that a result column is made of; sources are scopes or tables.

    A star is a name and a column of its own. Branches of a union have the names of the first by position. A name without a source counts where the
    scope has one source; else its source is null. Names are in capitals, tables without their schema.
    """
    star = lambda x: x.rlike(r"^(?:\w+\.)?\*$")
    alias = lambda x: F.regexp_extract(x, r"(?is)^.*[^\s.]\s+(?:AS\s+)?\"?(\w+)\"?$", 1)
    own = lambda x: F.when(star(x), "*").otherwise(F.upper(F.coalesce(F.nullif(alias(x), F.lit("")), F.regexp_extract(x, r"(\w+)\W*$", 1))))
    items = lambda text: F.transform(F.split(F.regexp_extract(text, r"(?is)^\s*SELECT\s+(?:DISTINCT\s+|ALL\s+)?(.*?)\s+FROM\s", 1), ","), lambda x: F.trim(x))
    # all that a scope says stands in its row, so names and sources are met there and nothing is joined
    branches = found.withColumn("branches", F.split("text", r"(?i)\bUNION(?:\s+ALL)?\b"))
    branch = branches.select("sql_id", "scope", F.transform(items(F.get("branches", F.lit(0))), lambda x: F.when(x != "", own(x))).alias("names"), F.explode("branches").alias("text"))
    clause = F.regexp_extract("text", r"(?is)\bFROM\b(.*?)(?:\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bCONNECT\b|$)", 1)
    pieces = F.split(clause, r"(?i),|\b(?:(?:INNER|LEFT|RIGHT|FULL|CROSS|OUTER|NATURAL)\s+)*JOIN\b")
    one = r"(?is)^\s*([\w.#]+)(?:\s+(?:AS\s+)?(?!(?:ON|USING)\b)(\w+))?"
    named = F.transform(pieces, lambda p: F.named_struct(F.lit("source"), F.upper(F.substring_index(F.regexp_extract(p, one, 1), ".", -1)), F.lit("q"), F.upper(F.regexp_extract(p, one, 2))))
    sources = F.transform(F.filter(named, lambda s: s["source"] != ""), lambda s: F.named_struct(F.lit("source"), s["source"], F.lit("q"), F.when(s["q"] == "", s["source"]).otherwise(s["q"])))
    branch = branch.select("sql_id", "scope", "names", sources.alias("sources"), items(F.col("text")).alias("items")).where("size(sources) > 0")
    each = branch.select("sql_id", "scope", "names", "sources", F.posexplode("items").alias("pos", "item"))
    each = each.select("sql_id", "scope", F.get("names", F.col("pos")).alias("name"), "sources", "item").where("item <> '' and name is not null")
    expr = F.when(alias(F.col("item")) != "", F.regexp_extract("item", r"(?is)^(.*[^\s.])\s+(?:AS\s+)?\"?\w+\"?$", 1)).otherwise(F.col("item"))
    each = each.withColumn("expr", expr)
    dotted = F.transform(all_of(F.col("expr"), r"\b\w+\.(?:\w+|\*)", 0), lambda x: F.struct(F.upper(F.substring_index(x, ".", 1)).alias("q"), F.upper(F.substring_index(x, ".", -1)).alias("c")))
    bare = F.when(star(F.col("item")), F.when(F.col("item") == "*", F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))).otherwise(F.transform(all_of(F.col("expr"), r"(?<![\w.#])([A-Za-z_]\w*+)(?!\s*[.{(])", 1), lambda x: F.upper(x)))
    bare = F.transform(F.filter(bare, lambda x: ~x.isin(*_WORDS)), lambda x: F.struct(F.lit(None).cast("string").alias("q"), x.alias("c")))
    refs = each.select("sql_id", "scope", "name", "sources", F.explode(F.array_distinct(F.concat(dotted, bare))).alias("r"))
    alone = F.array(F.when(F.size("sources") == 1, F.get("sources", F.lit(0))["source"]))
    met = F.when(F.col("r.q").isNull(), alone).otherwise(F.transform(F.filter("sources", lambda s: s["q"] == F.col("r.q")), lambda s: s["source"]))
    return refs.select("sql_id", "scope", "name", F.explode(met).alias("source"), F.col("r.c").alias("column")).where("sql_id is not null").distinct()


#: The patterns of scopes() and relations() for one statement in Python. Java's \w and \s are ASCII alone, its \b is not.
_W, _S = "[A-Za-z0-9_]", r"[ \t\n\r\f\v]"
_P = {
    name: re.compile(p.replace(r"\w", _W).replace(r"\W", "[^A-Za-z0-9_]").replace(r"\s", _S), flags)
    for name, p, flags in (
        ("group", _GROUP, 0), ("token", rf"{_GROUP}|[^()]+|[()]", 0), ("select", r"\(\s*SELECT\b", re.I), ("root", r"\s*(?:#|SELECT\b)", re.I), ("union", r"\bUNION(?:\s+ALL)?\b", re.I), ("star", r"(?:\w+\.)?\*$", 0),
        ("aliased", r"(.*[^ \t\n\r\f\v.])\s+(?:AS\s+)?\"?(\w+)\"?$", re.I | re.S), ("tail", r"(\w+)\W*$", 0), ("items", r"\s*SELECT\s+(?:DISTINCT\s+|ALL\s+)?(.*?)\s+FROM\s", re.I | re.S),
        ("clause", r"\bFROM\b(.*?)(?:\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bCONNECT\b|$)", re.I | re.S), ("joins", r",|\b(?:(?:INNER|LEFT|RIGHT|FULL|CROSS|OUTER|NATURAL)\s+)*JOIN\b", re.I),
        ("source", r"\s*([A-Za-z0-9_.#]+)(?:\s+(?:AS\s+)?(?!(?:ON|USING)\b)(\w+))?", re.I), ("dotted", r"\b\w+\.(?:\w+|\*)", 0), ("bare", r"(?<![A-Za-z0-9_.#])([A-Za-z_]\w*+)(?!\s*[.{(])", 0),
    )
}
_BRACES = str.maketrans("(),", "{};")


def _scopes_of(text: str) -> tuple[dict[str, str], int]:
    """Text of each scope of a statement, as scopes() has them, and how many rounds of brackets there were."""
    found, level = {}, 0
    while _P["group"].search(text):
        tokens = _P["token"].findall(text)
        for i, x in enumerate(tokens):
            if _P["select"].match(x):
                found[f"#{level}_{i}"] = x[1:-1]
                tokens[i] = f" #{level}_{i} "
            elif x[0] == "(" and len(x) > 1:
                tokens[i] = x.translate(_BRACES)
        text, level = "".join(tokens), level + 1
    if _P["root"].match(text):
        found["#"] = text
    return found, level


@lru_cache(1 << 14)
def _item(item: str) -> tuple[str, tuple[tuple[str | None, str], ...]]:
    """(name, references (qualifier, column)) of an item of a select."""
    star, aliased = _P["star"].match(item), _P["aliased"].match(item)
    tail = None if star or aliased else _P["tail"].search(item)
    name = "*" if star else aliased[2].upper() if aliased else tail[1].upper() if tail else ""
    expr = aliased[1] if aliased else item
    dotted = [tuple(x.upper().split(".")) for x in _P["dotted"].findall(expr)]
    bare = (["*"] if item == "*" else []) if star else [x.upper() for x in _P["bare"].findall(expr)]
    return name, tuple(dict.fromkeys(dotted + [(None, x) for x in bare if x not in _WORDS]))


def _items(text: str) -> list[str]:
    m = _P["items"].match(text)
    return [x.strip(" ") for x in (m[1] if m else "").split(",")]


def _relations_of(text: str) -> set[tuple[str, str | None, str]]:
    """(name, source, column) of a scope, as relations() has them."""
    branches, out = _P["union"].split(text), set()
    names = [_item(x)[0] if x else None for x in _items(branches[0])]
    for branch in branches:
        clause, sources = _P["clause"].search(branch), []
        for piece in _P["joins"].split(clause[1]) if clause else ():
            m = _P["source"].match(piece)
            source = m[1].rsplit(".", 1)[-1].upper() if m else ""
            if source:
                sources.append((source, (m[2] or "").upper() or source))
        if not sources:
            continue
        for name, item in zip(names, _items(branch)):
            if not item or name is None:
                continue
            for q, column in _item(item)[1]:
                met = [sources[0][0] if len(sources) == 1 else None] if q is None else [s for s, own in sources if own == q]
                out.update((name, source, column) for source in met)
    return out


def columns_of(text: str) -> set[tuple[str, str | None, str]]:
    """(name, table, column) of a statement without comments and strings: relations composed from the outermost select inward."""
    scopes_, most = _scopes_of(text)
    edges = {"#": _relations_of(scopes_["#"])} if "#" in scopes_ else {}
    now, done = edges.get("#", set()), set()
    for _ in range(most + 1):
        nested = {x for x in now if x[1] is not None and x[1].startswith("#")}
        done |= now - nested
        for source in {x[1] for x in nested} & scopes_.keys() - edges.keys():
            edges[source] = _relations_of(scopes_[source])
        now = {
            (below if name == column == "*" else name, to, column if below == then == "*" else then)
            for name, source, column in nested for below, to, then in edges.get(source, ()) if column == below or column == "*" or below == "*"
        }
        if not now:
            break
    return done


def _columns(statements: DataFrame) -> DataFrame:
    """columns() before rows of statements that share an id are made distinct."""
    plain = statements.where("sql is not null and sql_id is not null").select("sql_id", F.regexp_replace(sqltext.without_comments(F.col("sql")), r"'(?:[^']|'')*'", "0").alias("text"))

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = columns_of(text)
                rows += found
                at += [i] * len(found)
            part = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.string()) for x in part)], names=["sql_id", "name", "table_name", "column"])

    kind = statements.schema["sql_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"sql_id {kind}, name string, table_name string, column string")


def columns(statements: DataFrame) -> DataFrame:
    """(sql_id, name, table_name, column) of statements (sql_id, sql): the table columns that each result column comes from.

    Relations are composed from the outermost select inward, as often as selects are nested; a star takes on every name that stands
    below it. Columns whose source is open have a null table. Statements without a select or an id have none; those that share an id are read apart.
    A statement is read whole where it stands, so nothing is joined.
    """
    return _columns(statements).distinct()


def field_columns(statements: DataFrame, fields: DataFrame, targets: DataFrame) -> DataFrame:
    """(sql_id, java_field, column, original, table_name) of result map fields (sql_id, java_field, column) that come from target columns (column).

    original is the target that the result column was made of, by columns(); a field whose column is itself a target, but made of none,
    stands with a null original and table. Each side moves once.
    """
    wanted = targets.select(F.upper("column").alias("original")).distinct()
    key = ["sql_id", "name"]
    asked = fields.select("sql_id", "java_field", F.upper("column").alias("name"), "column").where("name is not null").repartition(*key).distinct()
    made = _columns(statements).withColumnRenamed("column", "original").join(wanted, "original").repartition(*key).distinct()
    met = asked.join(made.hint("merge"), key, "left").join(wanted.select(F.col("original").alias("_own")), F.col("name") == F.col("_own"), "left")
    return met.where("original is not null or _own is not null").select("sql_id", "java_field", "column", "original", "table_name")
