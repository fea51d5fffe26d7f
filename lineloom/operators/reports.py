"""Fields of the reports: utility calls by loop depth, endpoints of methods, first frames, relevant stacks, mapped methods."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import javatext
from ..functions.sqltext import all_of

def _closed(braces: Column) -> Column:
    """For each opening brace, the last first, whether one closes it."""
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<boolean>").alias("out"))
    step = lambda s, b: F.when(b == "}", F.struct((s["free"] + 1).alias("free"), s["out"].alias("out"))).otherwise(F.struct(F.greatest(s["free"] - 1, F.lit(0)).alias("free"), F.array_append(s["out"], s["free"] > 0).alias("out")))
    return F.aggregate(F.reverse(braces), start, step)["out"]


def calls_by_depth(code: Column, names: list[str]) -> Column:
    """Struct (dep0, dep1, dep2, max_loop_depth, total_calls): calls of the dotted names outside loops, in one, in two or more; blanks may stand round dots.

    Only methods named after encrypting or decrypting count; of a full signature its last two parts do. Null or empty code has none. A loop is
    the first block after its head, if that is closed. A fold over the loop heads, braces and calls that stand in code, with the loops that each
    open block stands for on a stack.
    """
    dotted = [".".join(n.split(".")[-2:]) if full else n for n, full in ((n.split("(")[0], "(" in n) for n in names)]
    wanted = [n for n in dict.fromkeys(dotted) if re.search("encrypt|decrypt", n.split(".")[-1], re.I)]
    calls = [r"\b" + r"\s*\.\s*".join(map(re.escape, n.split("."))) + r"\s*\(" for n in wanted]
    tokens = all_of(javatext.code_only(F.coalesce(code, F.lit(""))), "|".join([r"\b(?:for|while)\s*\(", "[{}]", *calls]), 0)
    closed = _closed(F.filter(tokens, lambda t: t.isin("{", "}")))
    names_of = ("heads", "opened", "depth", "dep0", "dep1", "dep2", "most", "total")
    start = F.struct(*(F.lit(0).alias(c) for c in names_of), F.array().cast("array<int>").alias("stack"))

    def step(s: Column, t: Column) -> Column:
        opens, closes, head = t == "{", t == "}", t.rlike("^(?:for|while)")
        call = ~opens & ~closes & ~head
        counts = F.coalesce(F.get(closed, F.size(closed) - 1 - s["opened"]), F.lit(False))
        push = F.when(counts, s["heads"]).otherwise(0)
        top = F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1), F.lit(0))
        at = lambda test: (call & test).cast("int")
        return F.struct(
            F.when(head, s["heads"] + 1).when(opens, 0).otherwise(s["heads"]).alias("heads"), (s["opened"] + opens.cast("int")).alias("opened"),
            (s["depth"] + F.when(opens, push).when(closes, -top).otherwise(0)).alias("depth"), (s["dep0"] + at(s["depth"] == 0)).alias("dep0"), (s["dep1"] + at(s["depth"] == 1)).alias("dep1"), (s["dep2"] + at(s["depth"] > 1)).alias("dep2"),
            F.when(call, F.greatest(s["most"], s["depth"])).otherwise(s["most"]).alias("most"), (s["total"] + call.cast("int")).alias("total"),
            F.when(opens, F.array_append(s["stack"], push)).when(closes & (F.size(s["stack"]) > 0), F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(s["stack"]).alias("stack"),
        )

    out = F.aggregate(tokens, start, step)
    return F.struct(out["dep0"].alias("dep0"), out["dep1"].alias("dep1"), out["dep2"].alias("dep2"), out["most"].alias("max_loop_depth"), out["total"].alias("total_calls"))


def endpoint_of_methods(methods: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(method, path) of distinct methods, against endpoints (method, path, ord).

    The endpoint of that signature, of several the last; else the first signature with the same last token; else null.
    """
    known = endpoints.where("method is not null and path <> ''").groupBy("method").agg(F.max_by("path", "ord").alias("exact"), F.min("ord").alias("ord"))
    token = F.substring_index("method", ".", -1)
    near = known.groupBy(token.alias("token")).agg(F.min_by("exact", "ord").alias("near"))
    found = methods.select("method").distinct().withColumn("token", token).join(known.select("method", "exact"), "method", "left").join(near, "token", "left")
    return found.select("method", F.coalesce("exact", "near").alias("path"))


def first_frames(stacks: Column) -> Column:
    """First frames of an array of stacks, each once, in their order, as text."""
    first = F.transform(stacks, lambda s: F.trim(F.get(s, F.lit(0))))
    return F.array_join(F.array_distinct(F.filter(first, lambda x: x.isNotNull() & (x != ""))), ",\n")


def relevant_stacks(stacks: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct stacks (column stack) whose first frame's class is the stem of one of the files (column path)."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    return stacks.withColumn("_class", F.substring_index(F.get("stack", F.lit(0)), ".", 1)).join(files.select(stem.alias("_class")).distinct(), "_class", "left_semi").select("stack").distinct()


def crypto_fields(inward: Column, outward: Column) -> Column:
    """Names of fields going in, then out, each once, as text."""
    none = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(inward, none), F.coalesce(outward, none)), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != ""))), ", ")


def mapped_methods(statements: DataFrame, known: DataFrame) -> DataFrame:
    """(namespace, sql_id, class_name, method) of distinct statements, against known (namespace, class_name, method, sql_id, ord).

    The first entry of the namespace with that sql_id, or with a method of that name; else the namespace's last part and the id.
    """
    s = statements.select("namespace", "sql_id").distinct()
    by_id = known.select("namespace", "sql_id", "class_name", "method", "ord")
    by_name = known.select("namespace", F.col("method").alias("sql_id"), "class_name", "method", "ord")
    first = by_id.unionByName(by_name).groupBy("namespace", "sql_id").agg(F.min_by(F.struct("class_name", "method"), "ord").alias("m"))
    found = s.join(first, ["namespace", "sql_id"], "left")
    return found.select("namespace", "sql_id", F.coalesce("m.class_name", F.substring_index("namespace", ".", -1)).alias("class_name"), F.coalesce("m.method", "sql_id").alias("method"))


def class_paths(names: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """(class_name, path) of distinct names: by the index of files with access (known: class_name, path, ord; the last
    counts), else the Java file (files: path) of that name with the least path; null without one."""
    n = names.select("class_name").distinct()
    k = known.groupBy("class_name").agg(F.max_by("path", "ord").alias("k"))
    stem = F.regexp_extract("path", r"([^/]+)\.java$", 1)
    f = files.where(stem != "").groupBy(stem.alias("class_name")).agg(F.min("path").alias("f"))
    return n.join(k, "class_name", "left").join(f, "class_name", "left").select("class_name", F.coalesce("k", "f").alias("path"))


def method_types(asked: DataFrame, methods: DataFrame, sources: DataFrame) -> DataFrame:
    """asked (path, method) with in_type and out_type: the first parameter's type, void without one, and the return type.

    Of the class named as the file its first method of that name counts, else what stands in the text of the file before
    the first such name with brackets, its parameters cut at the first comma, even inside a type; null without either.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    own = methods.where(F.col("class_name") == stem).groupBy("path", F.col("name").alias("method"))
    own = own.agg(F.min_by(F.struct(F.coalesce(F.get("params", F.lit(0))["type"], F.lit("void")).alias("in_type"), F.col("return_type").alias("out_type")), F.struct("start_line", "place")).alias("x"))
    left = asked.join(own, ["path", "method"], "left").join(sources.select("path", "text"), "path", "left")
    declared = lambda g: F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"([\w<>.,\[\]]+)\s+\Q"), F.col("method"), F.lit(r"\E\s*\(([^)]*)\)")), F.lit(g))
    out = F.nullif(declared(1), F.lit(""))
    head = F.trim(F.substring_index(F.trim(declared(2)), ",", 1))
    inward = F.when(out.isNull(), F.lit(None)).when(head == "", "void").otherwise(F.regexp_extract(head, r"^(\S+)", 1))
    return left.select(*asked.columns, F.coalesce(F.col("x.in_type"), inward).alias("in_type"), F.coalesce(F.col("x.out_type"), out).alias("out_type"))


def calling_methods(methods: DataFrame, sources: DataFrame, patterns: list[str]) -> DataFrame:
    """methods whose lines, from the declaration to the last, hold the name of one of the utility calls (`Util.name(..)`)."""
    names = sorted({m[1] for p in patterns if (m := re.search(r"\.(\w+)\s*\(", p))})
    lines = sources.select("path", F.split("text", "\n").alias("_lines"))
    body = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    inside = F.regexp_replace(body, r"^[^{]*", "")
    test = F.lit(False)
    for n in names:
        test = test | inside.contains(n)
    return methods.join(lines, "path").where(test).drop("_lines")


def stack_methods(stacks: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (path, method): for each of files (path) the methods of its class in the relevant stacks, in any frame."""
    frame = relevant_stacks(stacks, files).select(F.explode("stack").alias("f")).where(F.col("f").contains("."))
    frame = frame.select(F.substring_index("f", ".", 1).alias("stem"), F.regexp_replace("f", r"^[^.]*\.", "").alias("method")).distinct()
    named = files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem")).distinct()
    return named.join(frame, "stem").select("path", "method")


def statement_signatures(statements: DataFrame) -> DataFrame:
    """(path, signature, parameters) of mapper statements: the id after its namespace, if it has one, and the names of its parameters."""
    from ..functions.sqltext import parameters

    name = F.concat_ws(".", F.nullif(F.col("namespace"), F.lit("")), "sql_id")
    return statements.where("sql_id is not null").select("path", name.alias("signature"), parameters(F.col("sql")).alias("parameters"))
