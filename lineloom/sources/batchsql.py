"""SQL of batch projects: statements of query files, which files hold SQL in which dialect, the Java a query file belongs to."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, sqltext
from .mapper import texts

#: Ends of file names, and words in Java texts (upper case), that tell SQL files by dialect.
BY_NAME = {"mapper": ("xml", ["MAPPER.XML"]), "dqm": ("xml", ["DQM.XML"]), "bat_sql": ("xml", ["BAT_SQL.XML"]), "any_sql": ("xml", ["_SQL.XML"]), "dem_dqm": ("java", ["DEM.JAVA", "DQM.JAVA"])}
BY_TEXT = {"jdbc": ["SELECT ", "INSERT ", "UPDATE ", "DELETE "], "jpa": ["@ENTITY", "@TABLE", "@QUERY", "@NAMEDQUERY", "@REPOSITORY", "@JPAREPOSITORY"]}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_sql_file(path: Column, text: Column, dialect: str) -> Column:
    """Whether a file holds SQL of the dialect (a key of BY_NAME or BY_TEXT). Extensions count as written, names in any case; null is false."""
    if dialect in BY_NAME:
        extension, ends = BY_NAME[dialect]
        test = F.lit(False)
        for e in ends:
            test = test | F.upper(file_name(path)).endswith(e)
        return F.coalesce(path.endswith("." + extension) & test, F.lit(False))
    return F.coalesce(path.endswith(".java") & classify.holds(F.upper(text), BY_TEXT[dialect]), F.lit(False))


def statements(files: DataFrame, any_element: bool = False) -> DataFrame:
    """(path, place, sql_id, query_type, sql) of the `query` elements with an id below the root, or of all elements with one.

    The whole text below an element counts, comments of XML and SQL left out. Of a text that begins with no known verb the
    type is SELECT. Files that aren't XML, null texts and empty statements give no row.
    """

    def found(text):
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return []
        below = (e for e in root.iter() if e is not root and isinstance(e.tag, str) and (any_element or e.tag == "query"))
        return [(e.get("id"), "".join(texts(e)).strip()) for e in below if e.get("id")]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [(p, i, *x) for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, x in enumerate(found(t))]
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "place", "sql_id", "raw"), r)) for r in rows], schema)

    schema = pa.schema([("path", pa.string()), ("place", pa.int32()), ("sql_id", pa.string()), ("raw", pa.string())])
    got = files.select("path", "text").mapInArrow(run, "path string, place int, sql_id string, raw string").withColumn("sql", sqltext.without_comments(F.col("raw")))
    return got.where("sql <> ''").select("path", "place", "sql_id", F.coalesce(sqltext.query_type(F.col("sql")), F.lit("SELECT")).alias("query_type"), "sql")


def batch_java(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(path, java): for query files (path) the Java file that their names tell; null without one.

    The name without `_SQL` counts: in the same folder as written, in capitals or in small letters, else anywhere in any case,
    the least path of several.
    """
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    base = F.regexp_replace(F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", ""), "(?i)_SQL$", "")
    q = queries.select("path").distinct().select("path", base.alias("base"), folder(F.col("path")).alias("folder"))
    j = files.where(F.col("path").endswith(".java")).select("path").distinct().select(F.col("path").alias("java"), F.regexp_replace(file_name(F.col("path")), r"\.java$", "").alias("stem"), folder(F.col("path")).alias("at"))
    rank = F.when(F.col("stem") == F.col("base"), 0).when(F.col("stem") == F.upper("base"), 1).when(F.col("stem") == F.lower("base"), 2)
    near = q.join(j, (F.upper("base") == F.upper("stem")) & (F.col("folder") == F.col("at"))).select("path", rank.alias("rank"), "java").where("rank is not null")
    # of all files of a name only the first can count
    anywhere = q.join(j.groupBy(F.upper("stem").alias("name")).agg(F.min("java").alias("java")), F.upper("base") == F.col("name")).select("path", F.lit(3).alias("rank"), "java")
    hit = near.unionByName(anywhere)
    best = hit.groupBy("path").agg(F.min(F.struct("rank", "java")).alias("x")).select("path", F.col("x.java").alias("java"))
    return q.select("path").join(best, "path", "left")


def batch_files(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(path, layer, file): bat, the Java file of each query file, and batvo, the Java files below its folder with `batvo` in their path, in any case."""
    java = batch_java(queries, files).where("java is not null").select("path", F.lit("bat").alias("layer"), F.col("java").alias("file"))
    folder = F.regexp_extract(F.lower("path"), r"^(.*)/[^/]*$", 1)
    q = queries.select("path", folder.alias("folder")).distinct()
    vo = files.where(F.col("path").endswith(".java") & F.lower("path").contains("batvo")).select(F.col("path").alias("file")).distinct().select("file", F.split(F.lower("file"), "/").alias("parts"))
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    vo = vo.where(F.size("parts") > 1).select("file", F.explode(above).alias("folder"))
    return java.unionByName(q.join(vo, "folder").select("path", F.lit("batvo").alias("layer"), "file")).distinct()
