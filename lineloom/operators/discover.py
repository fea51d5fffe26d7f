"""Java files of batch query files by three rules, as a union with provenance: a row for each pair, with all rules that found it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import javatext
from ..functions.sqltext import all_of
from . import resolve

#: Rules in their order.
RULES = ("query path", "config", "name")


def _file(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def by_query_path(queries: DataFrame, java: DataFrame) -> DataFrame:
    """(path, file): query files that a call of setQueryPath in the Java text (path, text) names, by file name in any case. Comments name none."""
    calls = all_of(javatext.code_only(F.col("text"), literals=True), r"\bsetQueryPath\s*\(([^)]*)", 1)
    names = F.flatten(F.transform(calls, lambda c: all_of(c, r"[^\s\"'/\\+(]+\.(?i:xml)\b", 0)))
    named = java.select(F.col("path").alias("file"), F.explode(names).alias("n")).select("file", F.upper("n").alias("name")).distinct()
    return queries.select("path", F.upper(_file(F.col("path"))).alias("name")).join(named, "name").select("path", "file")


def config_entries(configs: DataFrame) -> DataFrame:
    """(config, query_file, class_name) of the elements with a query-file and a class in configs (path, text), in either order of attributes."""
    tags = all_of(F.regexp_replace("text", r"(?s)<!--.*?-->", " "), r"(?s)<[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>", 0)
    value = lambda name: F.regexp_extract("tag", rf"(?s)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    other = lambda name: F.regexp_extract("tag", rf"(?s)\s{name}\s*=\s*'([^']*)'", 1)
    each = configs.where(F.upper("path").endswith("_CFG.XML")).select(F.col("path").alias("config"), F.explode(tags).alias("tag"))
    got = lambda name: F.coalesce(F.nullif(value(name), F.lit("")), other(name))
    return each.select("config", got("query-file").alias("query_file"), got("class").alias("class_name")).where("query_file <> '' and class_name <> ''")


def by_config(queries: DataFrame, configs: DataFrame, types: DataFrame) -> DataFrame:
    """(path, file): two hops, from the name of the query file to the class of a config entry, and from the class to its file."""
    entries = config_entries(configs).select(F.upper(_file(F.col("query_file"))).alias("name"), "class_name").distinct()
    found = queries.select("path", F.upper(_file(F.col("path"))).alias("name")).join(entries, "name").select("path", "class_name").distinct()
    return resolve.resolve_class(found, types, "class_name").where("class_path is not null").select("path", F.col("class_path").alias("file"))


def by_name(queries: DataFrame, java: DataFrame) -> DataFrame:
    """(path, file): the Java file of the same folder whose name is that of the query file without _SQL, as written, in capitals or in small letters."""
    base = F.regexp_replace(_file(F.col("path")), r"_SQL\.(?:xml|XML)$", "")
    asked = queries.select("path", _folder(F.col("path")).alias("at"), F.explode(F.array_distinct(F.array(base, F.upper(base), F.lower(base)))).alias("stem"))
    files = java.where(F.col("path").endswith(".java")).select(F.col("path").alias("file"), _folder(F.col("path")).alias("at"), F.regexp_replace(_file(F.col("path")), r"\.java$", "").alias("stem"))
    return asked.join(files, ["at", "stem"]).select("path", "file")


def batch_sources(queries: DataFrame, java: DataFrame, configs: DataFrame, types: DataFrame) -> DataFrame:
    """(path, file, rules, first_rule) of query files (path), Java files (path, text), configs (path, text) and types (class_name, full_name, path).

    rules are all that found the pair, in the order of RULES; a query file without Java stands once, with nulls. Repeated rows count once.
    """
    asked, files = queries.select("path").where("path is not null").distinct(), java.where("path is not null")
    found = [by_query_path(asked, files), by_config(asked, configs, types), by_name(asked, files)]
    all_rules = None
    for rank, (rule, pairs) in enumerate(zip(RULES, found)):
        tagged = pairs.select("path", "file", F.lit(rank).alias("rank"), F.lit(rule).alias("rule"))
        all_rules = tagged if all_rules is None else all_rules.unionByName(tagged)
    ranked = F.array_sort(F.collect_set(F.struct("rank", "rule")))
    merged = all_rules.groupBy("path", "file").agg(F.transform(ranked, lambda x: x["rule"]).alias("rules"))
    return asked.join(merged, "path", "left").select("path", "file", F.array_join("rules", ", ").alias("rules"), F.get("rules", F.lit(0)).alias("first_rule"))
