"""Result stores: reads with a quarantine for damaged records, versions of tables, and a report sink with commit and abort."""

from __future__ import annotations

import json
import tempfile
import uuid
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CORRUPT = "_corrupt"
#: How a quoted empty text is read, so that it isn't taken for a null.
_EMPTY = "\ue000"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the driver ends; a local session without that setting gets a temporary one."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(found or tempfile.mkdtemp(prefix='lineloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def directory(level: int):
    """Name of the directory `level` steps above a file; of a partition directory its value."""
    return F.regexp_replace(F.element_at(F.split("_file", "/"), -1 - level), "^[^=]*=", "")


def quarantined(spark: SparkSession, path: str, schema: str, store: str, multi_line: bool = False, pattern: str = "*.json*") -> tuple[DataFrame, DataFrame]:
    """JSON records below path by an explicit schema, split in one pass into two tables below `store`: good ones, and damaged ones.

    Good: the columns of schema, ts, table_name and class_name of the directories `<ts>/<table>/<class>/<file>`. Damaged: file, modified_time,
    those three, record (its text) and digest (SHA-256 of it). A record that isn't JSON, or whose values don't fit the schema, is damaged;
    unknown fields are ignored, missing ones null. multi_line: a file is a record. pattern: names of the files.
    """
    read = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    rows = read.option("multiLine", str(multi_line).lower()).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified"))
    named = rows.withColumns({"ts": directory(3), "table_name": directory(2), "class_name": directory(1), "_good": F.col(CORRUPT).isNull()})
    named.write.partitionBy("_good").parquet(store)
    kept = spark.read.schema(named.schema).parquet(store)
    own = [c for c in named.columns if c not in (CORRUPT, "_file", "_modified", "_good")]
    digest = F.sha2(F.col(CORRUPT).cast("binary"), 256)
    bad = kept.where("not _good").select(F.col("_file").alias("file"), F.col("_modified").alias("modified_time"), "ts", "table_name", "class_name", F.col(CORRUPT).alias("record"), digest.alias("digest"))
    return kept.where("_good").select(*own), bad


class Version(WriterCommitMessage):
    """Rows of each section that a task has written: (section, file, rows)."""

    def __init__(self, parts: list[tuple[str | None, str, int]]):
        self.parts = parts


def cell(value: object) -> str:
    """A value as CSV: nothing for null, else quoted."""
    if value is None:
        return ""
    text = str(value).lower() if isinstance(value, bool) else value.isoformat(sep=" ") if hasattr(value, "hour") else str(value)
    return '"' + text.replace('"', '""') + '"'


class ReportWriter(DataSourceWriter):
    """Parts by section below a hidden folder of the job; commit() moves them to the version's folder and names it in the manifest last."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.section, self.columns, self.job = options["path"].rstrip("/"), options["section"], columns, uuid.uuid4().hex

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows) -> Version:
        files, base = self._files()
        context = TaskContext.get()
        folder = f"{base}/.{self.job}"
        files.create_dir(folder, recursive=True)
        parts: list[tuple[str | None, str, int]] = []
        out, now, n = None, None, 0
        for row in rows:
            if out is None or row[self.section] != now:
                if out:
                    out.close()
                    parts[-1] = (*parts[-1][:2], n)
                now, n = row[self.section], 0
                name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(parts):06d}.csv"
                out = files.open_output_stream(f"{folder}/{name}")
                parts.append((now, name, 0))
            out.write((",".join(cell(row[c]) for c in self.columns) + "\n").encode())
            n += 1
        if out:
            out.close()
            parts[-1] = (*parts[-1][:2], n)
        return Version(parts)

    def commit(self, messages) -> None:
        files, base = self._files()
        sections: dict[str, int] = {}
        for part in (p for m in messages if m for p in m.parts):
            name = "none" if part[0] is None else "s-" + quote(str(part[0]), safe="")
            if name not in sections:
                files.create_dir(f"{base}/{self.job}/{name}", recursive=True)
            files.move(f"{base}/.{self.job}/{part[1]}", f"{base}/{self.job}/{name}/{part[1]}")
            sections[name] = sections.get(name, 0) + part[2]
        files.create_dir(f"{base}/{self.job}", recursive=True)
        with files.open_output_stream(f"{base}/.{self.job}.json") as out:
            out.write(json.dumps({"version": self.job, "columns": self.columns, "sections": sections}).encode())
        files.move(f"{base}/.{self.job}.json", f"{base}/report.json")
        self.abort(messages)

    def abort(self, messages) -> None:
        """Nothing of the job but what a commit has moved stays; attempts that failed leave no parts."""
        files, base = self._files()
        if files.get_file_info(f"{base}/.{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/.{self.job}")


class Report(DataSource):
    """Sink `report` (options path and section): a version of a report at a time, whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options, schema.names)


def write_report(df: DataFrame, path: str, section: str, order: list[str]) -> None:
    """Write df as the next version of the report at path, in parts by section; rows of a part are in order. Earlier versions stay until cleared."""
    df.sparkSession.dataSource.register(Report)
    df.sortWithinPartitions(section, *order).write.format("report").option("path", path).option("section", section).mode("append").save()


def _manifest(spark: SparkSession, path: str) -> tuple[str, list[str]] | None:
    """Version and columns of the report at path; None without one."""
    found = spark.read.schema("version string, columns array<string>").option("pathGlobFilter", "report.json").json(path).collect()
    return (found[0].version, found[0].columns) if found else None


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last committed version of the report at path, by an explicit schema; hidden parts and other versions aren't read."""
    found = _manifest(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").option("escape", '"').option("emptyValue", _EMPTY)
    rows = read.csv(f"{path.rstrip('/')}/{found[0]}")
    return rows.select(*(F.when(F.col(c) != _EMPTY, F.col(c)).when(F.col(c) == _EMPTY, "").alias(c) if t == "string" else c for c, t in rows.dtypes))


def clear_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions of the report at path but the last, and what broken jobs have left; how many folders went."""
    found = _manifest(spark, path)
    files, base = fs.FileSystem.from_uri(path.rstrip("/"))
    old = [f for f in files.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory and (not found or f.base_name != found[0])]
    for f in old:
        files.delete_dir(f.path)
    return len(old)
