"""Which statements touch watched columns, what that means for endpoints, and the reports' joins and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext
from .graph import shared_checkpoints


def watched_access(statements: DataFrame, watched: DataFrame) -> DataFrame:
    """(sql_id, file, table_name) of statements (sql_id, file, sql) that touch watched columns (table_name, column_name, new_column).

    One of the table's old columns must be used, or the table alone if it has only new ones. SELECT * stands for all old
    columns where no column was found.
    """
    per = watched.groupBy(F.upper("table_name").alias("table_name")).agg(F.collect_set(F.when(~F.col("new_column"), F.upper("column_name"))).alias("old"))
    refs = statements.withColumn("table_name", F.explode(sqltext.table_names(F.col("sql"))))
    refs = refs.withColumn("used", sqltext.column_names(F.col("sql"), F.col("table_name")))
    star = (F.size("used") == 0) & F.col("sql").rlike(r"(?is)\bSELECT\s+\*\s+FROM\b")
    return refs.join(per, "table_name").where((F.size("old") == 0) | F.arrays_overlap("used", "old") | star).select("sql_id", "file", "table_name")


def main_layer(access: DataFrame) -> DataFrame:
    """(table_name, main_layer) of rows with file, layer and ord: the layer with most files, of equal ones the first."""
    n = access.groupBy("table_name", "layer").agg(F.count_distinct("file").alias("c"), F.min("ord").alias("o"))
    return n.groupBy("table_name").agg(F.max_by("layer", F.struct("c", -F.col("o"))).alias("main_layer"))


def table_rollup(access: DataFrame, statements: DataFrame) -> DataFrame:
    """(table_name, n_statements, statements, files, main_layer, query_type, layer_files) of access rows with file, layer and ord.

    statements and files are sorted; query_type is that of the first statement; layer_files maps layers to sorted files.
    """
    # read once: finding accesses takes most of the time, and they are used five times
    shared_checkpoints(access.sparkSession)
    access = access.select("table_name", "sql_id", "file", "layer", "ord").checkpoint()
    least = access.groupBy("table_name").agg(F.min("sql_id").alias("sql_id"))
    first = F.broadcast(least).join(statements.select("sql_id", "sql"), "sql_id").groupBy("table_name").agg(F.first(sqltext.query_type(F.col("sql"))).alias("query_type"))
    files = access.groupBy("table_name", "layer").agg(F.array_sort(F.collect_set("file")).alias("files")).groupBy("table_name")
    files = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "files")))).alias("layer_files"))
    ids = access.select("table_name", "sql_id").distinct().groupBy("table_name").agg(F.count("sql_id").alias("n_statements"), F.array_sort(F.collect_list("sql_id")).alias("statements"))
    out = ids.join(access.groupBy("table_name").agg(F.array_sort(F.collect_set("file")).alias("files")), "table_name")
    return out.join(main_layer(access), "table_name").join(first, "table_name").join(files, "table_name")


def with_fallback(left: DataFrame, right: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """left with one row of right each: equal keys and name, else equal keys and the same last part of the name; rows without are dropped.

    Of several rows the first by `order`.
    """
    own = [c for c in right.columns if c not in (*keys, name)]
    key = F.xxhash64(*keys, name)
    tail = lambda c: F.substring_index(F.lower(c), ".", -1)
    r = right.select(*keys, F.lower(name).alias("_name"), F.struct(*own).alias("_r"), F.col(order).alias("_o"))
    asked = left.select(*keys, name).distinct().withColumn("_key", key)
    exact = asked.join(r, keys).where(F.lower(name) == F.col("_name")).select("_key", F.lit(0).alias("_way"), "_o", "_r")
    near = asked.withColumn("_t", tail(F.col(name))).join(r.withColumn("_t", tail(F.col("_name"))), [*keys, "_t"]).select("_key", F.lit(1).alias("_way"), "_o", "_r")
    best = exact.unionByName(near).groupBy("_key").agg(F.min_by("_r", F.struct("_way", "_o")).alias("_r"))
    return left.withColumn("_key", key).join(best, "_key").select(*left.columns, "_r.*")


def template_pattern(path: Column) -> Column:
    """A path with {names} as a regular expression: names stand for anything, the rest for itself."""
    quoted = F.transform(F.split(path, r"\{[^}]+\}"), lambda x: F.regexp_replace(x, r"([\\.\[\](){}^$*+?|])", r"\\$1"))
    return F.array_join(quoted, ".+")


def _grams(text: Column) -> Column:
    """Runs of three letters."""
    at = F.when(F.length(text) > 2, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.lit("~"), F.substring(text, i, F.lit(3))))


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def _path_keys(path: Column) -> Column:
    """What a path can be found by: its segments (=), their beginnings (^), runs of three letters (~), and every number of slashes up to its own (#)."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    begins = F.flatten(F.transform(segments, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda n: F.concat(F.lit("^"), F.substring(x, F.lit(1), n)))))
    depths = F.transform(F.sequence(F.lit(0), _slashes(path)), lambda n: F.concat(F.lit("#"), n.cast("string")))
    return F.array_distinct(F.concat(F.transform(segments, lambda x: F.concat(F.lit("="), x)), begins, _grams(path), depths))


def _template_keys(template: Column) -> Column:
    """What every path that holds a match of a template has: its fixed segments between slashes and the beginning of a fixed last one; without
    any, the runs of three letters of its fixed parts; without any, its number of slashes."""
    parts = F.split(template, "/")
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: (x != "") & ~x.contains("{"))
    last = F.when(F.size(parts) > 1, F.regexp_extract(F.element_at(parts, -1), r"^[^{]*", 0))
    fixed = F.concat(F.transform(inner, lambda x: F.concat(F.lit("="), x)), F.array_compact(F.array(F.when(last != "", F.concat(F.lit("^"), last)))))
    grams = F.flatten(F.transform(F.split(template, r"\{[^}]+\}"), _grams))
    depth = F.array(F.concat(F.lit("#"), _slashes(template).cast("string")))
    return F.when(F.size(fixed) > 0, fixed).when(F.size(grams) > 0, grams).otherwise(depth)


def template_sums(templates: DataFrame, counts: DataFrame) -> DataFrame:
    """(end_point, n) of templates (end_point) against counts (path, access_cnt): the sum over paths matched whole, else over those that hold a match.

    A template meets the paths that have the rarest of its keys; the pattern is tested on what meets. Templates that differ in names alone are
    tested once, so those without a fixed part (`/{a}/{b}`) are few, and meet the paths with as many slashes.
    """
    shape = F.regexp_replace("end_point", r"\{[^}]+\}", "{a}")
    shapes = templates.select(shape.alias("shape")).distinct().withColumn("keys", _template_keys(F.col("shape")))
    paths = counts.groupBy("path").agg(F.sum("access_cnt").alias("c"))
    keyed = paths.select("path", "c", F.explode(_path_keys(F.col("path"))).alias("key"))
    asked = shapes.select("shape", F.explode("keys").alias("key"))
    n = keyed.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rarest = asked.join(n, "key", "left").groupBy("shape").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    hit = rarest.join(keyed.hint("merge"), "key").withColumn("p", template_pattern(F.col("shape"))).where("path rlike p").withColumn("whole", F.expr("path rlike concat('^', p, '$')"))
    sums = hit.groupBy("shape").agg(F.sum(F.when(F.col("whole"), F.col("c")).otherwise(0)).alias("w"), F.sum("c").alias("any"))
    found = sums.select("shape", F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("any")).alias("n"))
    return templates.select("end_point", shape.alias("shape")).distinct().join(found, "shape").select("end_point", "n")


def ending_rows(plain: DataFrame, counts: DataFrame) -> DataFrame:
    """(end_point, ord, access_cnt) of counts (path, access_cnt, ord) whose path ends with an end point.

    They meet on endings: an end point by what follows its first slash, or as it is without one, a path by its endings at slashes and the endings
    of its last segment.
    """
    border = F.when(F.col("end_point").contains("/"), F.substring("end_point", F.instr("end_point", "/"), F.length("end_point"))).otherwise(F.col("end_point"))
    parts = F.split("path", "/")
    slashes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    last = F.element_at(parts, -1)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.length(last), F.lit(1))), lambda n: F.right(last, n))
    tails = counts.select("path", "ord", "access_cnt", F.explode(F.array_distinct(F.concat(slashes, ends))).alias("tail"))
    return plain.withColumn("tail", border).join(tails.hint("merge"), "tail").where("endswith(path, end_point)").select("end_point", "ord", "access_cnt")


def endpoint_access(endpoints: DataFrame, counts: DataFrame) -> DataFrame:
    """(end_point, access_cnt) of distinct endpoints, against counts (path, access_cnt, ord).

    A path with {names}: the sum over paths that it matches whole; if that is 0, over those that hold a match. A plain path:
    the first equal path, else the first that ends with it, else 0. A blank endpoint has 0. Without counts all have 1.
    All joins are on equal keys: whole paths, endings of paths, fixed parts of templates.
    """
    ends = endpoints.select("end_point").distinct()
    if counts.isEmpty():
        return ends.withColumn("access_cnt", F.when(F.coalesce(F.trim("end_point"), F.lit("")) == "", 0).otherwise(1).cast("long"))
    filled = ends.where(F.trim("end_point") != "")
    plain, templates = filled.where(~F.col("end_point").contains("{")), filled.where(F.col("end_point").contains("{"))
    exact = plain.join(counts.hint("merge"), F.col("end_point") == F.col("path")).select("end_point", F.lit(0).alias("way"), "ord", "access_cnt")
    near = ending_rows(plain, counts).select("end_point", F.lit(1).alias("way"), "ord", "access_cnt")
    first = exact.unionByName(near).groupBy("end_point").agg(F.min_by("access_cnt", F.struct("way", "ord")).alias("n"))
    found = first.unionByName(template_sums(templates, counts))
    return ends.join(found.hint("merge"), "end_point", "left").select("end_point", F.coalesce("n", F.lit(0)).cast("long").alias("access_cnt"))


def endpoint_rollup(queries: DataFrame, access: DataFrame) -> DataFrame:
    """(end_point, total_weight, n_queries, access_cnt, estimated_calls, queries) of rows (end_point, table_name, query_id, weight)."""
    q = F.array_sort(F.collect_list(F.struct("table_name", "query_id", "weight")))
    r = queries.groupBy("end_point").agg(F.sum("weight").alias("total_weight"), F.count("*").alias("n_queries"), q.alias("queries"))
    cnt = F.coalesce("access_cnt", F.lit(0))
    return r.join(access, "end_point", "left").select("end_point", "total_weight", "n_queries", cnt.alias("access_cnt"), (F.col("total_weight") * cnt).alias("estimated_calls"), "queries")


def code_rollup(queries: DataFrame, access: DataFrame) -> DataFrame:
    """(end_point, total_weight, estimated_calls): blank endpoints left out; without accesses the estimate is the weight itself."""
    r = queries.where(F.trim(F.coalesce("end_point", F.lit(""))) != "").groupBy("end_point").agg(F.sum("weight").alias("total_weight")).join(access, "end_point", "left")
    return r.select("end_point", "total_weight", F.when(F.col("access_cnt") > 0, F.col("total_weight") * F.col("access_cnt")).otherwise(F.col("total_weight")).alias("estimated_calls"))


def report_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count("*").alias("n_endpoints"), F.coalesce(F.sum("estimated_calls"), F.lit(0)).alias("estimated_calls"))


def method_access(method_endpoints: DataFrame, access: DataFrame) -> DataFrame:
    """(method, access_cnt, primary): accesses of all endpoints that reach a method, and the first of these."""
    return method_endpoints.join(access.withColumnRenamed("end_point", "endpoint"), "endpoint", "left").groupBy("method").agg(F.coalesce(F.sum("access_cnt"), F.lit(0)).alias("access_cnt"), F.min("endpoint").alias("primary"))


def changed_files(new: DataFrame, old: DataFrame | None, key: str = "path", text: str = "text") -> DataFrame:
    """(key, status): files of new that old lacks, or has with other text; without old all are new. Texts meet as digests."""
    side = lambda d, n: d.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias(n))
    if old is None:
        return new.select(key, F.lit("new").alias("status"))
    both = side(new, "n").join(side(old, "o"), key, "left")
    return both.where("o is null or o <> n").select(key, F.when(F.col("o").isNull(), "new").otherwise("changed").alias("status"))


def added_lines(new: DataFrame, old: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_lines): lines that new has more often than old, counted by key."""
    lines = lambda d: d.select(key, F.explode(F.split(text, "\n")).alias("line"))
    n = lines(new).groupBy(key, "line").agg(F.count("*").alias("n")).join(lines(old).groupBy(key, "line").agg(F.count("*").alias("o")), [key, "line"], "left")
    return n.withColumn("d", F.col("n") - F.coalesce("o", F.lit(0))).where("d > 0").groupBy(key).agg(F.sum("d").alias("n_lines"))


def enclosing_counts(ranges: DataFrame, key: str, group: str, start: str, end: str) -> DataFrame:
    """(key, n_enclosing): ranges of the same group that hold each range's start, itself included.

    No pairs are made: of a sorted line of starts and ends, those opened before and not closed yet are counted.
    """
    marks = ranges.select(key, group, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("d")))).alias("m")).select(key, group, "m.*")
    w = Window.partitionBy(group).orderBy(F.struct("at", "kind"))
    return marks.withColumn("n", F.sum("d").over(w)).where("kind = 0").select(key, F.col("n").alias("n_enclosing"))


def coverage(ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(n_all, n_found, n_missing, percent) of the distinct keys of ids in found."""
    a = ids.select(key).distinct().join(found.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return a.agg(F.count("*").alias("n_all"), F.count("_hit").alias("n_found"), (F.count("*") - F.count("_hit")).alias("n_missing"), F.round(100.0 * F.count("_hit") / F.greatest(F.count("*"), F.lit(1)), 1).alias("percent"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks; null keys are not compared."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key), key, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with equal keys, or added."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def only_reachable(methods: DataFrame, reachable: DataFrame, key: str) -> DataFrame:
    """methods that are reachable; if nothing is, all."""
    return methods if reachable.isEmpty() else methods.join(reachable.select(key).distinct(), key, "left_semi")


def modification_stats(records: DataFrame, by: list[str], status: str = "status", file: str = "file", good: str = "success") -> DataFrame:
    """Totals by key: rows, successes, what isn't one, and distinct files with one."""
    ok = F.col(status) == good
    return records.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(F.coalesce(~ok, F.lit(True))).alias("failed"), F.count_distinct(F.when(ok, F.col(file))).alias("success_files"))


def corrected(df: DataFrame, reported: str, actual: str) -> DataFrame:
    """df with corrected and was_wrong: what was counted goes before what was reported; a null report is wrong."""
    wrong = ~F.col(reported).eqNullSafe(F.col(actual))
    return df.withColumn("corrected", F.when(wrong, F.col(actual)).otherwise(F.col(reported))).withColumn("was_wrong", wrong)


def report_order(df: DataFrame, endpoint: str, then: list[str], buckets: int = 64) -> DataFrame:
    """df with position: filled endpoints first, in order regardless of case, then blank ones, then by `then`.

    Ranges of the order are numbered side by side; only their sizes, one row each, come together.
    """
    order = [(F.coalesce(F.col(endpoint), F.lit("")) == "").alias("_blank"), F.lower(F.coalesce(F.col(endpoint), F.lit(""))).alias("_low")]
    keyed = df.select("*", *order)
    keys = ["_blank", "_low", *then]
    parts = keyed.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    parts = parts.checkpoint()
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = parts.join(F.broadcast(before), "_part").withColumn("position", F.col("_id") - F.col("_first") + F.col("_before") + 1)
    return out.drop("_blank", "_low", "_part", "_id", "_first", "_before")


def text_totals(df: DataFrame, by: str, text: str) -> DataFrame:
    """Characters and estimated tokens by key."""
    return df.groupBy(by).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("chars"), F.sum(F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("long").alias("tokens"))


def keyword_groups(df: DataFrame, path: str, keywords: list[str] | None = None) -> DataFrame:
    """(keyword, n_files): files by the last directory of the path that is a keyword; without keywords by the first directory."""
    word = F.regexp_extract(path, rf"^.*/({'|'.join(keywords)})/", 1) if keywords else F.regexp_extract(path, "^/([a-z]+)/", 1)
    return df.groupBy(word.alias("keyword")).agg(F.count("*").alias("n_files"))
