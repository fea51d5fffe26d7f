"""Methods of Java sources by their lines: ranges by braces, texts, and what became of each between two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import javatext
from ..functions.sqltext import all_of
from . import prefix, reports

_HEAD = r"^[\s}]*(?:@\w+(?:\s*\([^)]*\))?\s*)*(?:(?:public|protected|private|abstract|static|synchronized|native|default|final)\s+)+(?:<[^>]*>\s*)?[\w$.]+(?:\s*<[^(){}=;]*>)?(?:\s*\[\s*\])*\s+([a-z_$][\w$]*)\s*\("


def code_lines(sources: DataFrame) -> DataFrame:
    """(path, line, text, code) of sources (path, text): lines from 1, code without comments and the contents of literals."""
    zipped = F.arrays_zip(F.split("text", "\n").alias("text"), F.split(javatext.code_only(F.col("text")), "\n").alias("code"))
    return sources.select("path", F.posexplode(zipped).alias("n", "x")).select("path", (F.col("n") + 1).alias("line"), "x.text", "x.code")


def longest(sources: DataFrame) -> int:
    """Lines of the longest text."""
    return sources.agg(F.max(F.size(F.split("text", "\n")))).first()[0] or 0


def _count(code: Column, sign: str) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit(sign), F.lit("")))


def _dip(code: Column) -> Column:
    """The lowest that the number of open blocks falls in a line, against its start."""
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("low"))
    step = lambda s, b: (s["now"] + F.when(b == "{", 1).otherwise(-1)).alias("now")
    return F.aggregate(all_of(code, "[{}]", 0), none, lambda s, b: F.struct(step(s, b), F.least(s["low"], s["now"] + F.when(b == "{", 1).otherwise(-1)).alias("low")))["low"]


def ranges(sources: DataFrame) -> DataFrame:
    """(path, name, nth, start_line, end_line) of the methods with a modifier in sources (path, text); nth counts those of a name in a file from 1.

    A method starts where its head stands and ends with the first line that closes the block it opens: the next line in which
    the number of open blocks falls to that before the head, an as-of join backward on (file, depth). A head that ends with a semicolon is a line alone, one
    without an end goes to none. Methods within methods (local and anonymous classes) belong to the outer one. Names that start with
    a capital are constructors. Null text has none.
    """
    last = longest(sources)
    lines = code_lines(sources.where(F.col("text").isNotNull()))
    delta = _count(F.col("code"), "{") - _count(F.col("code"), "}")
    depth = prefix.running_sum(lines.select("path", "line", "code", delta.alias("delta")), ["path"], "line", F.col("delta"), "open", last=last, unique=True)
    name = F.regexp_extract("code", _HEAD, 1)
    shut = F.length(F.replace(F.regexp_extract("code", r"^[\s}]*", 0), F.lit(" "), F.lit("")))
    marked = depth.withColumn("low", F.col("open") + _dip(F.col("code"))).withColumn("after", F.col("open") + F.col("delta")).withColumn("name", F.nullif(name, F.lit(""))).withColumn("depth", F.col("open") - shut)
    alone = (F.col("after") <= F.col("depth")) & (F.col("code").contains("}") & F.col("code").contains("{") | F.col("code").rlike(r";\s*$"))
    heads = marked.where("name is not null").select("path", "depth", "line", "name", F.when(alone, F.col("line")).alias("own_end"), F.lit(None).cast("int").alias("shut"))
    falls = marked.where("low < open").select("path", F.explode(F.sequence("low", F.col("open") - 1)).alias("depth"), "line", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("own_end"), F.col("line").alias("shut"))
    ended = prefix.as_of(heads.unionByName(falls), ["path", "depth"], "line", F.col("shut"), "next_shut", backward=True, last=last)
    ended = ended.where("name is not null").select("path", "name", F.col("line").alias("start_line"), F.coalesce("own_end", "next_shut").alias("end_line")).where("end_line is not null")
    outer = prefix.running_max(ended, ["path"], "start_line", F.col("end_line"), "reached", last=last, unique=True).where("reached is null or reached <= start_line").drop("reached")
    nth = F.row_number().over(Window.partitionBy("path", "name").orderBy("start_line"))
    return outer.select("path", "name", nth.alias("nth"), "start_line", "end_line")


def bodies(sources: DataFrame) -> DataFrame:
    """ranges() with the text of each method's lines, comments included."""
    found = ranges(sources)
    lines = code_lines(sources.where(F.col("text").isNotNull())).select("path", F.col("line").alias("first"), F.col("line").alias("last"), "text")
    each = prefix.meet_ranges(lines, found, "path", ("first", "last"), ("start_line", "end_line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n")
    return each.groupBy("path", "name", "nth", "start_line", "end_line").agg(text.alias("text"))


def texts(sources: DataFrame) -> DataFrame:
    """ranges() with the digest of each method's lines, in which runs of white space are one blank."""
    digest = F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")).cast("binary"), 256)
    return bodies(sources).select("path", "name", "nth", "start_line", "end_line", digest.alias("digest"))


def of_stacks(stacks: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, name, nth, text): methods of files (path) that stand in the relevant stacks, with their lines in sources (path, text)."""
    asked = reports.stack_methods(stacks, files).withColumnRenamed("method", "name")
    return bodies(sources.join(files.select("path").distinct().hint("merge"), "path", "left_semi")).join(asked.hint("merge"), ["path", "name"], "left_semi").select("path", "name", "nth", "text")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, nth, status, old_start, old_end, start, end, other_path) of the methods of two versions of sources (path, text).

    A full outer join on (path, name, nth): same, changed, added or removed. An added method whose text was removed under another path or
    place, and the removed one, are moved; other_path is where the other one stands, of several the first.
    """
    side = lambda d, a, b, c: texts(d).select("path", "name", "nth", F.col("start_line").alias(a), F.col("end_line").alias(b), F.col("digest").alias(c))
    both = side(old, "old_start", "old_end", "was").join(side(new, "start", "end", "now"), ["path", "name", "nth"], "full")
    gone = both.where("now is null").groupBy(F.col("was").alias("digest")).agg(F.min("path").alias("gone_path"))
    come = both.where("was is null").groupBy(F.col("now").alias("digest")).agg(F.min("path").alias("come_path"))
    moved = gone.join(come.hint("merge"), "digest")
    rows = both.withColumn("digest", F.when(F.col("was").isNull(), F.col("now")).when(F.col("now").isNull(), F.col("was"))).join(moved.hint("merge"), "digest", "left")
    status = F.when(F.col("gone_path").isNotNull(), "moved").when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    other = F.when(F.col("was").isNull(), F.col("gone_path")).when(F.col("now").isNull(), F.col("come_path"))
    return rows.select("path", "name", "nth", status.alias("status"), "old_start", "old_end", "start", "end", other.alias("other_path"))


def of_lines(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """lines (path, line), each once, with the name of the method of sources that holds it; null outside methods."""
    return prefix.enclosing(lines, ranges(sources))
