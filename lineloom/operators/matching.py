"""Matches of qualified names, and differences of texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixes(name: Column) -> Column:
    """`a.b.c`, `b.c`, `c`."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def signature_match(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) of names that are equal, or one ends with "." and the other; equal keys instead of comparing all pairs."""
    x, y = left.select(a).distinct(), right.select(b).distinct()
    longer = x.withColumn(b, F.explode(suffixes(F.col(a)))).join(y, b)
    shorter = y.withColumn(a, F.explode(suffixes(F.col(b)))).join(x, a)
    return longer.select(a, b).unionByName(shorter.select(a, b)).distinct()


def line_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """df with changes: array of (tag, old_start, old_end, new_start, new_end), 0-based line ranges; null text is empty."""
    def run(o: pd.Series, n: pd.Series) -> pd.Series:
        def one(a, b):
            m = difflib.SequenceMatcher(None, (a or "").split("\n"), (b or "").split("\n"), autojunk=False)
            return [dict(zip(("tag", "old_start", "old_end", "new_start", "new_end"), x)) for x in m.get_opcodes() if x[0] != "equal"]

        return pd.Series([one(a, b) for a, b in zip(o, n)])

    kind = "array<struct<tag:string,old_start:int,old_end:int,new_start:int,new_end:int>>"
    return df.withColumn("changes", F.pandas_udf(run, kind)(old, new))


def named_files(asked: DataFrame, files: DataFrame, least: float = 0.7) -> DataFrame:
    """asked (request, ident, code) with file and way: which of the files (request, idx, path, text) of its request an answer means.

    In order: the tag FILE_<idx>, the file name, the name in any case, package and class of the code, the name with the
    largest ratio of equal parts, at least `least`. The last of files with one name counts for names, the first for code.
    None: file null, way failed. A request's files stood in one prompt, so they are few.
    """
    from ..functions.javatext import without_comments

    base = lambda p: F.regexp_extract(p, r"([^/]*)/*$", 1)
    package = lambda c: F.nullif(F.regexp_extract(without_comments(c), r"\bpackage\s+([\w.]+)\s*;", 1), F.lit(""))
    kind = lambda c: F.nullif(F.regexp_extract(without_comments(c), r"\b(?:class|interface|enum)\s+(\w+)", 1), F.lit(""))
    f = files.select("request", F.struct("idx", "path", base(F.col("path")).alias("name"), package(F.col("text")).alias("package"), kind(F.col("text")).alias("kind")).alias("f"))
    f = f.groupBy("request").agg(F.array_sort(F.collect_list("f")).alias("_files"))
    a = asked.join(f, "request", "left").withColumn("_files", F.coalesce("_files", F.expr("array()").cast("array<struct<idx:int,path:string,name:string,package:string,kind:string>>")))
    a = a.withColumn("_name", base(F.trim("ident"))).withColumn("_package", package(F.col("code"))).withColumn("_kind", kind(F.col("code")))
    a = a.withColumn("_idx", F.expr(r"try_cast(nullif(regexp_extract(trim(ident), '(?i)^FILE_([0-9]+)', 1), '') as int)"))
    first = lambda test: F.get(F.filter("_files", test), F.lit(0))["path"]
    last = lambda test: F.get(F.reverse(F.filter("_files", test)), F.lit(0))["path"]
    same = lambda x: (x["kind"] == F.col("_kind")) & F.coalesce(x["package"] == F.col("_package"), F.lit(True))
    ways = {
        "index": first(lambda x: x["idx"] == F.col("_idx")),
        "exact": last(lambda x: x["name"] == F.col("_name")),
        "case_insensitive": last(lambda x: F.lower(x["name"]) == F.lower("_name")),
        "signature": first(same),
    }
    known = F.coalesce(*ways.values())

    def near(name: pd.Series, names: pd.Series) -> pd.Series:
        def one(n, many):
            best, out = 0.0, None
            for x in dict.fromkeys(many) if isinstance(n, str) else ():
                r = difflib.SequenceMatcher(None, n.lower(), x.lower()).ratio()
                if r > best and r >= least:
                    best, out = r, x
            return out

        return pd.Series([one(*x) for x in zip(name, names)], dtype=object)

    names = F.when(known.isNull(), F.transform("_files", lambda x: x["name"])).otherwise(F.array().cast("array<string>"))
    a = a.withColumn("_near", F.pandas_udf(near, "string")("_name", names))
    file = F.coalesce(known, last(lambda x: x["name"] == F.col("_near")))
    way = F.lit("failed")
    for k, test in reversed([*ways.items(), ("fuzzy", file)]):
        way = F.when(test.isNotNull(), k).otherwise(way)
    return a.withColumn("file", file).withColumn("way", way).drop("_files", "_name", "_package", "_kind", "_idx", "_near")
