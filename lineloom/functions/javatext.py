"""What Java sources declare, as Column expressions over their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sqltext import all_of

_STRING = r'"(?:[^"\\\n]++|\\.)*+"' + r"|'(?:[^'\\\n]++|\\.)*+'"
_ANNOTATIONS = r"(?:@\w+(?:\s*\([^)]*\))?\s*)*"
#: Words of a type that stand for several values.
MANY = ("list", "collection", "set", "map", "queue", "deque", "stack", "vector", "iterable", "stream", "[]", "array")


def without_comments(source: Column) -> Column:
    """Comments out; what looks like one inside a string or character literal stays."""
    return F.regexp_replace(source, rf"({_STRING})|//[^\n]*|(?s:/\*.*?\*/)", "$1")


def code_only(source: Column, literals: bool = False) -> Column:
    """source with nothing but line ends left of its comments and nothing between the quotes of its literals, or all of these; it has as many lines."""
    tokens = all_of(source, rf"(?s:/\*.*?(?:\*/|\z))|//[^\n]*|{_STRING}|[^/\"']++|(?s:.)", 0)
    kept = lambda x: F.when(x.startswith("/*"), F.regexp_replace(x, r"[^\n]++", "")).when(x.startswith("//"), "").when(F.lit(not literals) & x.rlike("^[\"'].*[\"']$"), F.concat(F.left(x, F.lit(1)), F.left(x, F.lit(1)))).otherwise(x)
    return F.array_join(F.transform(tokens, kept), "")


_MODIFIER = "(?:public|private|protected|static|final|abstract|synchronized|native|default|transient|volatile)"
_TYPE = r"[A-Za-z_$][\w$.]*(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*"
_NO_TYPE = r"(?!(?:return|new|throw|else|case|goto|package|import|class|interface|enum|extends|implements|instanceof)\b)"


def class_names(source: Column) -> Column:
    """Names after class; what stands in comments or strings, or after a dot (`X.class`), is none."""
    return _some(all_of(without_comments(source), rf"{_STRING}|(?<![.\w$])class\s+([A-Za-z_$][\w$]*)"))


def _some(found: Column) -> Column:
    return F.filter(found, lambda x: x != "")


def method_names(source: Column) -> Column:
    """Names of methods with a body or a semicolon: modifiers in any order, a type, a name, parameters; calls are none."""
    params = r"\((?:[^;{}()]|\([^()]*\))*\)"
    declared = rf"(?:^|[;{{}})>\s])(?:{_MODIFIER}\s+)*(?:<[^;{{}}()]*>\s*)?{_NO_TYPE}{_TYPE}\s+([A-Za-z_$][\w$]*)\s*{params}\s*(?:throws\s+[\w.,\s]+)?[{{;]"
    return _some(all_of(without_comments(source), declared))


def field_names(source: Column) -> Column:
    """Names that follow a type and stand before = or ; with at least one modifier or annotation ahead."""
    return _some(all_of(without_comments(source), rf"(?:{_MODIFIER}\s+|@\w+(?:\s*\([^)]*\))?\s+)+{_NO_TYPE}{_TYPE}\s+([A-Za-z_$][\w$]*)\s*(?:=[^=]|;)"))


def _arguments(annotation: Column) -> Column:
    """What stands between the brackets of an annotation."""
    return F.trim(F.regexp_extract(annotation, r"(?s)^\s*@?[\w.]+\s*\((.*)\)\s*$", 1))


def annotation_path(annotation: Column) -> Column:
    """Path of a mapping annotation: its value or path, or what is given without a name; of an array the first. Null without one."""
    head = F.regexp_extract(annotation, r"(?s)(@[\w.]+\s*(?:\([^)]*\))?)", 1)
    given = _arguments(head)
    named = F.regexp_extract(given, r"(?s)(?:^|,)\s*(?:path|value)\s*=\s*\{?\s*\"([^\"]*)\"", 1)
    alone = F.regexp_extract(given, r"(?s)^\{?\s*\"([^\"]*)\"", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(alone, F.lit("")))


def http_method(annotation: Column) -> Column:
    """HTTP verb of a mapping annotation; a request mapping without method is GET, others null."""
    name = F.upper(F.regexp_extract(annotation, r"@?(?:\w+\.)*(\w+?)Mapping\b", 1))
    asked = F.upper(F.regexp_extract(annotation, r"RequestMethod\s*\.\s*([A-Za-z]+)", 1))
    return F.when(name.isin("GET", "POST", "PUT", "DELETE", "PATCH"), name).when(name == "REQUEST", F.coalesce(F.nullif(asked, F.lit("")), F.lit("GET")))


def endpoints(sources: DataFrame) -> DataFrame:
    """(path, class_name, method_name, http_method, end_point) of the handler methods in sources (path, text)."""
    code = sources.select("path", without_comments(F.col("text")).alias("code"))
    head = F.regexp_extract("code", rf"@RequestMapping\s*\([^)]*\)\s*{_ANNOTATIONS}(?:(?:public|abstract|final)\s+)*class\s+\w+", 0)
    name = F.regexp_extract("code", r"\bclass\s+(\w+)", 1)
    handler = rf"@(?:Get|Post|Put|Delete|Patch|Request)Mapping(?:\s*\([^)]*\))?\s*{_ANNOTATIONS}(?:public|protected|private)\s+(?!class\b)[\w<>\[\],.?]+(?:\s*<[^>]*>)?\s+\w+\s*\("
    found = code.select("path", name.alias("class_name"), F.coalesce(annotation_path(head), F.lit("")).alias("base"), F.explode(all_of(F.col("code"), handler, 0)).alias("h"))
    mapping = F.regexp_extract("h", r"^@\w+(?:\s*\([^)]*\))?", 0)
    own = F.coalesce(annotation_path(mapping), F.lit(""))
    joined = F.concat_ws("/", *(F.nullif(F.regexp_replace(x, "^/+|/+$", ""), F.lit("")) for x in (F.col("base"), own)))
    return found.select("path", "class_name", F.regexp_extract("h", r"(\w+)\s*\($", 1).alias("method_name"), http_method(mapping).alias("http_method"), F.concat(F.lit("/"), joined).alias("end_point"))


def embedded_sql(sources: DataFrame) -> DataFrame:
    """(path, kind, sql) of the statements in string literals: JDBC calls, JPA queries, string builders."""
    lit = r'"((?:[^"\\]|\\.)*)"'
    ways = {
        "jdbc": rf"\b(?:prepareStatement|prepareCall|executeQuery|executeUpdate|execute|createStatement)\s*\(\s*{lit}",
        "jpa_query": rf"@Query\s*\(\s*(?:value\s*=\s*)?{lit}",
        "jpa_named": rf"@NamedQuery\s*\([^)]*?query\s*=\s*{lit}",
        "jpa_create": rf"\bcreate(?:Native)?Query\s*\(\s*{lit}",
    }
    code = sources.select("path", without_comments(F.col("text")).alias("code"))
    found = lambda kind, way: F.transform(all_of(F.col("code"), way), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("sql")))
    plain = F.concat(*(found(k, w) for k, w in ways.items()))
    one = code.select("path", F.explode(plain).alias("s")).select("path", "s.kind", "s.sql")
    # builders: the appended literals of each variable, in order
    adds = code.where(F.col("code").contains(".toString()")).select("path", F.posexplode(all_of(F.col("code"), rf"\b\w*(?i:sql)\w*\s*\.append\(\s*{lit}", 0)).alias("n", "a"))
    parts = adds.select("path", "n", F.regexp_extract("a", r"^(\w+)", 1).alias("v"), F.regexp_replace(F.regexp_extract("a", lit, 1), r"\\[ntr]", " ").alias("t"))
    built = parts.groupBy("path", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "").alias("sql"))
    return one.unionByName(built.select("path", F.lit("builder").alias("kind"), "sql"))


def inner_type(kind: Column) -> Column:
    """Last type argument: `Map<K, V>` gives V; a type without arguments is its own."""
    inside = F.regexp_extract(kind, r"<([^>]*)>", 1)
    return F.when(inside == "", kind).otherwise(F.trim(F.element_at(F.split(inside, ","), -1)))


def cardinality(kind: Column) -> Column:
    """none, single or multiple values, by words in the type."""
    low = F.lower(kind)
    many = F.lit(False)
    for w in MANY:
        many = many | low.contains(w)
    return F.when(F.coalesce(kind, F.lit("")).isin("", "void") | (low == "null"), "none").when(many, "multiple").otherwise("single")


def service_endpoints(sources: DataFrame) -> DataFrame:
    """(path, class_name, method_name, http_method, end_point) of methods with a service id, below the local name of their class.

    http_method is ServiceIdMapping. Local name and id are joined by one slash; a method without an id is none.
    """
    code = sources.select("path", without_comments(F.col("text")).alias("code"))
    local = annotation_path(F.regexp_extract("code", rf"@LocalName\s*\([^)]*\)\s*{_ANNOTATIONS}(?:(?:public|abstract|final)\s+)*class\s+\w+", 0))
    handler = rf"@ServiceIdMapping\s*\([^)]*\)\s*{_ANNOTATIONS}(?:{_MODIFIER}\s+)*{_NO_TYPE}{_TYPE}\s+[A-Za-z_$][\w$]*\s*\("
    found = code.select("path", F.regexp_extract("code", r"\bclass\s+(\w+)", 1).alias("class_name"), F.coalesce(local, F.lit("")).alias("base"), F.explode(all_of(F.col("code"), handler, 0)).alias("h"))
    own = annotation_path(F.regexp_extract("h", r"^@\w+\s*\([^)]*\)", 0))
    joined = F.when(F.col("base") == "", own).otherwise(F.concat(F.regexp_replace("base", "/$", ""), F.lit("/"), F.regexp_replace(own, "^/", "")))
    return found.where(own.isNotNull()).select("path", "class_name", F.regexp_extract("h", r"([\w$]+)\s*\($", 1).alias("method_name"), F.lit("ServiceIdMapping").alias("http_method"), joined.alias("end_point"))


def mapping_paths(sources: DataFrame) -> DataFrame:
    """Distinct (path, http_method, end_point) of all mapping annotations of controllers, wherever they stand.

    The first request mapping is the base and an endpoint itself. A path that begins with the base, or of which both begin
    with /api, stands alone; else it follows the base. Slashes are single. A request mapping without method is GET.
    """
    marks = all_of(F.translate(F.coalesce("text", F.lit("")), "'", '"'), r"@(?:\w+\.)*\w+Mapping\b(?:\s*\((?:[^()\"]|\"[^\"]*\")*+\))?", 0)
    marks = F.filter(F.transform(marks, lambda m: F.struct(m.alias("m"), annotation_path(m).alias("own"))), lambda x: x["own"].isNotNull() & http_method(x["m"]).isNotNull())
    request = F.filter(marks, lambda x: x["m"].rlike(r"^@(?:\w+\.)*RequestMapping\b"))
    rooted = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    base = F.nullif(F.regexp_replace(F.get(request, F.lit(0))["own"], "/+$", ""), F.lit(""))
    found = sources.select("path", rooted(base).alias("base"), F.explode(marks).alias("x")).select("path", "base", "x.*")
    own = rooted(F.col("own"))
    alone = F.col("base").isNull() | own.startswith(F.col("base")) | (own.startswith("/api") & F.col("base").startswith("/api"))
    full = F.regexp_replace(F.when(alone, own).otherwise(F.concat("base", own)), "/+", "/")
    return found.select("path", http_method(F.col("m")).alias("http_method"), full.alias("end_point")).distinct()
