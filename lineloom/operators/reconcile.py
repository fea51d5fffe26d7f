"""The analysis report's outer join: what is known of statements, what was analysed and what was planned, with nothing lost on any side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import first_frames


def token(name: Column) -> Column:
    """Last part of a dotted id."""
    return F.substring_index(name, ".", -1)


def ordered_distinct(rows: DataFrame, by: list[str], value: str, at: str, name: str, sep: str = ", ") -> DataFrame:
    """(by, name): the distinct values of each group in the order of their first places, joined; blanks round values, and blank values, go.

    The least place of each value is combined before anything moves, so a group with few values and any number of rows is a few
    rows; only its distinct values meet.
    """
    text = F.trim(F.col(value).cast("string"))
    first = rows.where(text != "").groupBy(*by, text.alias("_v")).agg(F.min(at).alias("_at"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]), sep).alias(name))


def first_rows(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of rows with equal keys, nulls being equal too, the one with the least place; of equal places the least row."""
    return rows.groupBy(*keys).agg(F.min(F.struct(at, F.struct(*rows.columns).alias("row"))).alias("x")).select("x.row.*")


def _known(analysed: DataFrame, flows: DataFrame) -> DataFrame:
    """(table_name, grain, key, s1, s2): the first analysed and the first planned row by whole id (grain 0) and by last token (grain 1)."""
    tagged = lambda d, own, other: d.where("query_id is not null").select("table_name", "query_id", "ord", F.struct(*[c for c in d.columns if c not in ("table_name", "ord")]).alias(own), F.lit(None).alias(other))
    both = tagged(analysed, "s1", "s2").unionByName(tagged(flows, "s2", "s1"))
    keys = F.array(F.struct(F.lit(0).alias("grain"), F.col("query_id").alias("key")), F.struct(F.lit(1).alias("grain"), token(F.col("query_id")).alias("key")))
    each = both.withColumn("k", F.explode(keys)).select("table_name", "k.*", "ord", "s1", "s2")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c].alias(c)
    return each.groupBy("table_name", "grain", "key").agg(first("s1"), first("s2"))


def models(in_category: Column, in_class: Column, out_category: Column, out_class: Column) -> Column:
    """Names of the value or map classes of a query's input and output, each once, in order of names."""
    own = lambda c, n: F.when(c.isin("VO", "MAP"), F.nullif(n, F.lit("")))
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(own(in_category, in_class), own(out_category, out_class))))), ", ")


def result_map_state(result_map: Column, n_fields: Column) -> Column:
    """X without a result map, a triangle for one without fields, else a circle."""
    return F.when(F.coalesce(result_map, F.lit("")) == "", "X").when(F.coalesce(n_fields, F.lit(0)) == 0, "△").otherwise("○")


def report(access: DataFrame, analysed: DataFrame, flows: DataFrame, instructions: DataFrame) -> DataFrame:
    """One row for each row of access, and for each analysed or planned query of a table that no access row means, with where it was found.

    access (table_name, sql_id, ord, source_path, access_files, stacks, result_map, n_fields), analysed (table_name, query_id, ord,
    in_category, in_class, out_category, out_class, summary), flows (table_name, query_id, ord, flow_id), instructions (table_name,
    flow_id, query_id, ord, file_name, method, action). A query means the access rows of its table with its id, else
    those with its last token; of several the first. An instruction belongs to a flow by flow id, else to its query id. Mapper, result map
    and end point are those of the first access row of the table with the same last token (the mapper: the first that has
    one; its source file, else the first access file, else the first frame). found: both, analysed, planned or neither for access rows, only
    analysed and only planned for others. All lookups are by keys of one row each, so no group's rows are paired. Rows without a
    table or an id are kept and mean nothing.
    """
    frame = F.get(F.get("stacks", F.lit(0)), F.lit(0))
    path = F.coalesce(F.nullif(F.col("source_path"), F.lit("")), F.get("access_files", F.lit(0)), frame)
    base = access.withColumn("token", token(F.col("sql_id"))).withColumn("path", path)
    state = F.struct(result_map_state(F.col("result_map"), F.col("n_fields")).alias("result_map"), first_frames(F.col("stacks")).alias("end_point"))
    place = F.struct("ord", "sql_id")
    shared = base.where("token is not null").groupBy("table_name", "token").agg(F.min_by(state, place).alias("state"), F.min_by("path", F.when(F.col("path").isNotNull(), place)).alias("mapper"))
    known = _known(analysed, flows)
    whole = known.where("grain = 0").select("table_name", F.col("key").alias("sql_id"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    loose = known.where("grain = 1").select("table_name", F.col("key").alias("token"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    rows = base.select("table_name", "sql_id", "token", "ord").join(shared, ["table_name", "token"], "left").join(whole, ["table_name", "sql_id"], "left").join(loose, ["table_name", "token"], "left")
    rows = rows.withColumn("s1", F.coalesce("a1", "b1")).withColumn("s2", F.coalesce("a2", "b2"))
    yes1, yes2 = F.col("s1").isNotNull(), F.col("s2").isNotNull()
    rows = rows.withColumn("found", F.when(yes1 & yes2, "both").when(yes1, "analysed").when(yes2, "planned").otherwise("neither"))
    meant = base.where("token is not null").select("table_name", "token").distinct()
    left = whole.withColumn("token", token(F.col("sql_id"))).join(meant, ["table_name", "token"], "left_anti")
    each = F.explode(F.array(F.struct(F.lit("only analysed").alias("found"), F.col("a1").alias("s1"), F.lit(None).alias("s2")), F.struct(F.lit("only planned").alias("found"), F.lit(None).alias("s1"), F.col("a2").alias("s2"))))
    left = left.select("table_name", "sql_id", "token", each.alias("x")).select("table_name", "sql_id", "token", "x.*").where("s1 is not null or s2 is not null")
    rows = rows.unionByName(left, allowMissingColumns=True)
    what = F.struct("ord", "file_name", "method", "action")
    by_flow = instructions.where("flow_id is not null").groupBy("table_name", F.col("flow_id").cast("string").alias("flow")).agg(F.min(what).alias("i1"))
    by_query = instructions.where("query_id is not null").groupBy("table_name", F.col("query_id").alias("sql_id")).agg(F.min(what).alias("i2"))
    rows = rows.withColumn("flow", F.col("s2.flow_id").cast("string")).join(by_flow, ["table_name", "flow"], "left").join(by_query, ["table_name", "sql_id"], "left")
    told = F.when(F.col("s2").isNotNull(), F.coalesce("i1", "i2"))
    model = models(*(F.col(f"s1.{c}") for c in ("in_category", "in_class", "out_category", "out_class")))
    return rows.withColumn("told", told).select(
        "table_name", "sql_id", F.col("token").alias("display_id"), "ord", F.substring_index("mapper", "/", -1).alias("mapper"), "state.result_map", "state.end_point",
        F.regexp_replace("told.file_name", r"\.java", "").alias("class_name"), "told.method", "told.action", model.alias("model"), F.col("s1.summary").alias("summary"), "found",
    )
