"""Project trees, counts and lists as DataFrames; only the listing is read until contents are asked for."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that hold no sources.
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", "target", "build", "out", "bin", ".idea", ".vscode", ".settings", "node_modules",
    "__pycache__", ".pytest_cache", ".gradle", ".mvn",
)
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def _glob(name: Column, relative: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        r = fnmatch.translate(p)
        hit = hit | name.rlike(f"^{r}") | relative.rlike(f"^{r}")
    return hit


def keep(files: DataFrame, path: str, top: str = "", extensions: Sequence[str] = (".java", ".xml"), exclude_dirs: Sequence[str] = (), exclude_files: Sequence[str] = ()) -> DataFrame:
    """Rows of files whose path may be a source, with relative_path (below top), filename and extension.

    A file is left out if any part of its whole path is an excluded directory or starts with a dot, or if an exclude
    pattern fits its name or relative path. Extensions are compared without case; without any all are taken.
    """
    parts = F.split(path, "/")
    out = files.withColumn("filename", F.element_at(parts, -1)).withColumn("relative_path", F.expr(f"substring(`{path}`, {len(top) + 2})"))
    banned = sorted({*EXCLUDED_DIRS, *exclude_dirs})
    bad = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(banned) | x.startswith("."))
    out = out.withColumn("extension", F.regexp_extract("filename", r".(\.[^.]*)$", 1)).where(~bad & ~F.col("filename").startswith("."))
    if extensions:
        out = out.where(F.lower("extension").isin([e.lower() for e in extensions]))
    if exclude_files:
        out = out.where(~_glob(F.col("filename"), F.col("relative_path"), exclude_files))
    return out


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = (".java", ".xml"), exclude_dirs: Sequence[str] = (), exclude_files: Sequence[str] = (), content: bool = False) -> DataFrame:
    """(path, relative_path, filename, extension, size, modified_time[, content]) of the files below root that keep() takes, one row a path.

    Spark's listing doesn't see names that start with "_". An empty tree gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    out = keep(files.withColumn("p", F.regexp_replace("path", _SCHEME, "")), "p", top, extensions, exclude_dirs, exclude_files)
    cols = [F.col("p").alias("path"), "relative_path", "filename", "extension", F.col("length").alias("size"), F.col("modificationTime").alias("modified_time")]
    return out.select(*cols, *(["content"] if content else [])).dropDuplicates(["path"])


def text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else a Korean code page, else Latin-1, which takes all."""
    return F.pandas_udf(_decode, "string")(content)


def _decode(content: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        for codec in ("utf-8", "euc-kr", "cp949"):
            try:
                return b.decode(codec)
            except UnicodeDecodeError:
                pass
        return b.decode("latin-1")

    return content.map(one)


def access_counts(spark: SparkSession, path: str) -> DataFrame:
    """(end_point, access_cnt) of lines `end_point,count` or `end_point count`; blank and malformed lines are skipped, the
    last line of an end point counts, of several files in the order of their names."""
    # the place of a line: its file, the block of the file, and the order in which the block is read
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(F.trim("value").alias("v"), place.alias("n"))
    parts = F.when(F.col("v").contains(","), F.transform(F.split("v", ","), lambda x: F.trim(x))).otherwise(F.split("v", r"\s+"))
    rows = lines.where("v <> ''").select("n", F.get(parts, F.lit(0)).alias("end_point"), F.get(parts, F.lit(1)).try_cast("bigint").alias("c"))
    return rows.where("c is not null").groupBy("end_point").agg(F.max_by("c", "n").alias("access_cnt"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path) of a list of changed files: byte order mark, comments, repeated and leading slashes removed."""
    line = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    lines = spark.read.text(path).select(line.alias("v")).where("v <> '' and not startswith(v, '#')")
    return lines.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("v", r"\\", "/"), "/+", "/"), "^/", "").alias("relative_path")).distinct()


def latest(df: DataFrame, by: str = "ts") -> DataFrame:
    """Rows of the latest partition that has rows."""
    return df.join(F.broadcast(df.agg(F.max(by).alias(by))), by, "left_semi")


def save(df: DataFrame, path: str) -> str:
    """Result store: df as a new version of the table at path; the versions before it stay. The version's name is the time (UTC)."""
    version = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    df.write.parquet(f"{path}/version={version}")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions of the table at path, in their order; one whose write has failed is none."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(sc._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
    return sorted(f.getPath().getParent().getName().split("=")[1] for f in found or [])


def version_info(spark: SparkSession, path: str) -> DataFrame:
    """(version, n_files, bytes) of the whole versions of the table at path; contents aren't read."""
    whole = versions(spark, path)
    if not whole:
        return spark.createDataFrame([], "version string, n_files long, bytes long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{path}/version={v}" for v in whole])
    version = F.regexp_extract("path", r"/version=([^/]*)/[^/]*$", 1)
    return found.groupBy(version.alias("version")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def load(spark: SparkSession, path: str, schema: str, version: str | None = None) -> DataFrame:
    """A version of the table at path, by default the last whole one, by an explicit schema; without one no rows."""
    version = version or max(versions(spark, path), default=None)
    return spark.read.schema(schema).parquet(f"{path}/version={version}") if version else spark.createDataFrame([], schema)


def to_parse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, modified_time) the parse cache lacks."""
    return files.join(cache.select("path", "modified_time").distinct(), ["path", "modified_time"], "left_anti")


def shown(df: DataFrame, n: int = 20) -> str:
    """A table as text, as the console lists show it."""
    return df._show_string(n, truncate=False)
