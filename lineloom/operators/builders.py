"""SQL statements that Java methods build in variables: each append meets the declaration of its variable by an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import javatext, sqltext
from . import prefix

_TEXT = r'"(?:[^"\\\n]|\\.)*+"'
_TOKEN = rf"(?i:\bStringBuilder\s+\w*sql\w*\s*=\s*new\s+StringBuilder\s*\(\s*\)|(?:\b\w+\s*)?\.\s*append\s*\(\s*{_TEXT}|\b\w+\s*\.\s*toString\s*\()|{_TEXT}|'(?:[^'\\\n]|\\.)'|\n"


def tokens(sources: DataFrame) -> DataFrame:
    """(path, pos, line, kind, variable, piece) of sources (path, text): declarations of builders, appends of literals and uses, in their order.

    Kinds: declare, append, use; an append that follows another one (`a.append("x").append("y")`) is without a variable.
    Variables are in lower case; a piece is the literal as it is written. Comments and other literals hold none.
    """
    found = sources.select("path", F.posexplode(sqltext.all_of(javatext.code_only(F.col("text"), literals=True), _TOKEN, 0)).alias("pos", "t"))
    # each token holds a line end, a quote or a bracket
    last = sources.agg(F.max(F.length("text") - F.length(F.translate("text", "\n\"'(", "")))).first()[0] or 0
    breaks = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))
    numbered = prefix.running_sum(found, ["path"], "pos", breaks, "line", last=last, unique=True)
    kind = F.when(F.col("t").rlike(r"(?is)^StringBuilder\s.*new"), "declare").when(F.col("t").rlike(rf"(?is)^\w*\s*\.\s*append\s*\(\s*{_TEXT}$"), "append").when(F.col("t").rlike(r"(?is)^\w+\s*\.\s*toString"), "use")
    name = F.when(kind == "declare", F.regexp_extract("t", r"(?is)^StringBuilder\s+(\w+)", 1)).otherwise(F.regexp_extract("t", r"^(\w+)\s*\.", 1))
    rows = numbered.select("path", "pos", (F.col("line") + 1).alias("line"), kind.alias("kind"), F.nullif(F.lower(name), F.lit("")).alias("variable"), F.regexp_extract("t", rf"({_TEXT})$", 1).alias("piece"))
    return rows.where("kind is not null")


def unquoted(piece: Column) -> Column:
    """The text of a literal: line ends, tabs, quotes and backslashes unescaped."""
    inside = F.expr("substring(%s, 2, length(%s) - 2)" % (("piece",) * 2)) if piece is None else F.substring(piece, F.lit(2), F.length(piece) - 2)
    parts = sqltext.all_of(inside, r"(?s)\\.|[^\\]++", 0)
    plain = {r"\n": "\n", r"\t": "\t", r"\r": "\r"}

    def one(x: Column) -> Column:
        out = F.when(x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)
        for k, v in plain.items():
            out = F.when(x == k, v).otherwise(out)
        return out

    return F.array_join(F.transform(parts, one), "")


def statements(sources: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """(path, class_name, method, line, query_type, sql, parameter_type, result_type) of the statements built in variables named after SQL.

    methods (path, class_name, name, params, return_type, start_line, end_line), types (class_name, full_name, path). A token belongs
    to the innermost method round its line. An append or a use belongs to the nearest declaration of its variable before it in
    that method, one without a variable to that of the token before; line is that of the declaration. What is never used, or holds nothing, is no
    statement. query_type is SELECT where the text names no verb. The types are the full names of the first parameter type,
    and of the return type, that is a known class; of containers the last type argument counts, of several classes of a name the first by path.
    """
    found = tokens(sources)
    ranges = methods.select("path", "class_name", F.col("name").alias("method"), "params", "return_type", "start_line", "end_line")
    inside = prefix.meet_ranges(found.withColumn("_l", F.col("line")), ranges, "path", ("line", "_l"), ("start_line", "end_line"))
    key = ["path", "pos", "line", "kind", "variable", "piece"]
    own = inside.groupBy(*key).agg(F.max_by(F.struct("class_name", "method", "start_line"), F.struct("start_line", F.expr("-end_line"))).alias("m")).select(*key, "m.*")
    last = sources.agg(F.max(F.length("text") - F.length(F.translate("text", "\n\"'(", "")))).first()[0] or 0
    named = prefix.as_of(own, ["path", "start_line", "class_name"], "pos", F.col("variable"), "before", last=last, unique=True)
    named = named.withColumn("variable", F.coalesce("variable", "before")).drop("before")
    met = prefix.as_of(named, ["path", "start_line", "class_name", "variable"], "pos", F.when(F.col("kind") == "declare", F.struct("pos", "line")), "declared", last=last, unique=True)
    met = met.where("kind <> 'declare' and declared is not null")
    place = ["path", "class_name", "method", "start_line", "variable", "declared"]
    piece = F.when(F.col("kind") == "append", F.struct("pos", "piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: unquoted(x["piece"])), "")
    built = met.groupBy(*place).agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("sql"), F.bool_or(F.col("kind") == "use").alias("used")).where("used and sql <> ''")
    known = types.groupBy("class_name").agg(F.min_by("full_name", "path").alias("full_name")).select(F.col("class_name").alias("kind"), "full_name")
    asked = ranges.select("path", "class_name", "method", "start_line", F.posexplode(F.concat(F.array(F.col("return_type")), F.transform("params", lambda p: p["type"]))).alias("place", "t"))
    full = asked.withColumn("kind", javatext.inner_type(F.col("t"))).join(known.hint("merge"), "kind")
    full = full.groupBy("path", "class_name", "method", "start_line").agg(F.min_by(F.when(F.col("place") > 0, F.col("full_name")), F.when(F.col("place") > 0, F.col("place"))).alias("parameter_type"), F.max(F.when(F.col("place") == 0, F.col("full_name"))).alias("result_type"))
    out = built.join(full.hint("merge"), ["path", "class_name", "method", "start_line"], "left")
    return out.select("path", "class_name", "method", F.col("declared.line").alias("line"), F.coalesce(sqltext.query_type(F.col("sql")), F.lit("SELECT")).alias("query_type"), "sql", "parameter_type", "result_type")
