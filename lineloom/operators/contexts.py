"""Which files go together into one request: batch files with their query file and value objects, layers in batches, utilities, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batching


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def batch_contexts(bats: DataFrame, values: DataFrame, queries: DataFrame) -> DataFrame:
    """(path, kind, file) of batch files (path, project, imports) with value objects (path, project) and query files (path).

    vo: a value object of the project whose name is the last part of an import, in any case. all vo: no import means one, so all of the project
    stand for it; the row has a null file, as the list is the same for all of them. xml: the file `<name>_SQL.xml` in the folder, else in
    the folder above, else in the folder xml beside a folder bat. Repeated rows count once.
    """
    asked = bats.select("path", "project", "imports").dropDuplicates(["path", "project"])
    names = asked.select("path", "project", F.explode_outer(F.transform("imports", lambda i: F.lower(F.substring_index(i, ".", -1)))).alias("name")).distinct()
    known = values.select("project", F.lower(_stem(F.col("path"))).alias("name"), F.col("path").alias("file")).distinct()
    vo = names.join(known, ["project", "name"]).select("path", F.lit("vo").alias("kind"), "file").distinct()
    some = asked.join(values.select("project").distinct(), "project", "left_semi")
    rest = some.join(vo.select("path").distinct(), "path", "left_anti").select("path", F.lit("all vo").alias("kind"), F.lit(None).cast("string").alias("file")).distinct()
    folder, above = _folder(F.col("path")), _folder(_folder(F.col("path")))
    own = F.concat(F.lit("/"), _stem(F.col("path")), F.lit("_SQL.xml"))
    places = F.array(F.concat(folder, own), F.concat(above, own), F.when(folder.rlike(r"(?:^|/)bat$"), F.concat(above, F.lit("/xml"), own)))
    where = asked.select("path", F.posexplode(places).alias("rank", "file")).where("file is not null").join(queries.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    xml = where.groupBy("path").agg(F.min_by("file", "rank").alias("file")).select("path", F.lit("xml").alias("kind"), "file")
    return vo.unionByName(rest).unionByName(xml)


def layer_batches(files: DataFrame, prompt: int, separator: int, budget: int) -> DataFrame:
    """(table_name, layer, path, batch) of files (table_name, layer, path, tokens): each table's layers in batches within the budget.

    Layers are compared in small letters; files that stand twice in a layer count once, in the order of paths.
    """
    rows = files.groupBy("table_name", F.lower("layer").alias("layer"), "path").agg(F.max("tokens").alias("tokens"))
    packed = rows.withColumn("g", F.struct("table_name", "layer"))
    out = batching.greedy_batches(packed, "g", "path", "tokens", prompt, separator, budget)
    return out.select("g.table_name", "g.layer", "path", "batch")


def source_root(path: Column, package: Column) -> Column:
    """Folder that a file's package starts in: its folder without the package; null if the folder doesn't end with it."""
    folder, tail = _folder(path), F.replace(package, F.lit("."), F.lit("/"))
    return F.when(F.coalesce(package, F.lit("")) == "", folder).when(folder == tail, "").when(F.endswith(folder, F.concat(F.lit("/"), tail)), F.left(folder, F.length(folder) - F.length(tail) - 1))


def utility_files(types: DataFrame, files: DataFrame, words: list[str]) -> DataFrame:
    """Distinct (path, file): the files (path) that imports of types (path, package, imports) with one of the words mean, below the source root of the
    importing file; wildcards and roots that can't be told mean none."""
    asked = types.select("path", source_root(F.col("path"), F.col("package")).alias("root"), F.explode("imports").alias("i")).where("root is not null and not endswith(i, '*')")
    low = F.lower("i")
    test = F.lit(False)
    for w in words:
        test = test | low.contains(w.lower())
    want = asked.where(test).select("path", F.concat(F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))), F.replace("i", F.lit("."), F.lit("/")), F.lit(".java")).alias("file")).distinct()
    return want.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("path", "file")


def backups(files: DataFrame) -> DataFrame:
    """(path, backup, number): files with their copies `<file>.backup` and `<file>.backup.<n>`; number is 0 for the first. Files without one, and copies of nothing, have none."""
    copy = r"^(.*)\.backup(?:\.(\d+))?$"
    seen = files.select("path").where("path is not null").distinct()
    copies = seen.where(F.col("path").rlike(copy)).select(F.regexp_extract("path", copy, 1).alias("of"), F.col("path").alias("backup"), F.coalesce(F.regexp_extract("path", copy, 2).try_cast("int"), F.lit(0)).alias("number"))
    return seen.join(copies, F.col("path") == F.col("of")).select("path", "backup", "number")
