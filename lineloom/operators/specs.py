"""Specifications of classes: each comment is attached to the declaration that follows it, and read as rows of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import all_of
from . import prefix

#: Labels of titles, authors, histories and dates in comments.
TITLES = (r"\bTITLE\b", "제목", r"프로그램\s*개요", "프로그램명", r"\bSUMMARY\b")
AUTHORS = r"(?i)(?:@?author\b[:\s]*|작성자\s*[:=\-]\s*)(.*)"
HISTORIES = ("history", "이력", "변경이력")
DATES = (r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}", r"\d{4}년\s*\d{1,2}월\s*\d{1,2}일", r"\d{4}[.\-]\d{2}")

_LITERAL = r'"(?:[^"\\\n]|\\.)*+"' + r"|'(?:[^'\\\n]|\\.)*+'"
_NOTE = r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()\"]|\"(?:[^\"\\]|\\.)*+\")*+\))?"
_MODIFIERS = r"(?:(?:public|protected|private|abstract|final|static|synchronized|native|default|strictfp)\s+)"
_CLASS = rf"{_MODIFIERS}*+\b(?:class|interface|enum)\s+\w+(?:\s*<[^{{}}()]*>)?(?:\s+extends\s+[\w.<>, ]+?)?(?:\s+implements\s+[\w.<>,\s]+?)?\s*\{{"
_METHOD = rf"{_MODIFIERS}++(?:<[^>(){{}};]*>\s*)?[\w$.]+(?:\s*<[^(){{}};=]*>)?(?:\s*\[\s*\])*\s+\w+\s*\([^(){{}};]*\)\s*(?:throws\s+[\w.,\s]+?)?\s*[{{;]"
_COMMENT = r"(?s:/\*.*?\*/)|//[^\n]*(?:\n[ \t]*//[^\n]*)*+"
_TOKEN = rf"{_COMMENT}|{_LITERAL}|{_NOTE}|{_CLASS}|{_METHOD}|\w++|[^\s\w]"


def declarations(sources: DataFrame) -> DataFrame:
    """(path, place, kind, name, extends, implements, return_type, params, comment, style) of the classes and methods of sources (path, text).

    A class takes the last javadoc before it, else the last block comment, else the run of line comments above it with nothing but annotations
    between; a method takes a javadoc above it with nothing but annotations between. These are as-of joins over the file's tokens, in
    which other code is a barrier. Methods have a modifier. place numbers the tokens of a file. Null text has no rows.
    """
    found = sources.select("path", F.posexplode(all_of(F.col("text"), _TOKEN, 0)).alias("place", "t"))
    last = sources.agg(F.max(F.length("text"))).first()[0] or 0
    t = F.col("t")
    kind = (
        F.when(t.startswith("/**") & (F.length("t") > 4), "javadoc").when(t.startswith("/*"), "block").when(t.startswith("//"), "line").when(t.rlike(r"^[\"']"), "code").when(t.rlike(rf"(?s)^{_NOTE}$"), "note")
        .when(t.rlike(rf"(?s)^(?:{_CLASS})$"), "class").when(t.rlike(rf"(?s)^(?:{_METHOD})$"), "method").otherwise("code")
    )
    rows = found.withColumn("kind", kind)
    own = lambda k: F.when(F.col("kind") == k, F.struct(F.lit(k).alias("style"), F.col("t").alias("comment")))
    near = F.when(F.col("kind") != "note", F.struct(F.col("kind").alias("style"), F.when(F.col("kind").isin("javadoc", "line"), F.col("t")).alias("comment")))
    for name, value in (("javadoc", own("javadoc")), ("block", own("block")), ("near", near)):
        rows = prefix.as_of(rows, ["path"], "place", value, name, last=last, unique=True)
    of_class = F.coalesce("javadoc", "block", F.when(F.col("near.style") == "line", F.col("near")))
    of_method = F.when(F.col("near.style") == "javadoc", F.col("near"))
    rows = rows.where(F.col("kind").isin("class", "method")).withColumn("c", F.when(F.col("kind") == "class", of_class).otherwise(of_method))
    is_class = F.col("kind") == "class"
    part = lambda pattern: F.nullif(F.trim(F.regexp_extract("t", pattern, 1)), F.lit(""))
    name = F.when(is_class, part(r"\b(?:class|interface|enum)\s+(\w+)")).otherwise(part(r"(?s)(\w+)\s*\("))
    names = F.when(is_class, F.transform(F.split(part(r"(?s)\bimplements\s+([\w.<>,\s]+?)\s*\{"), r"\s*,\s*"), lambda x: F.trim(x)))
    return rows.select(
        "path", "place", "kind", name.alias("name"), F.when(is_class, part(r"(?s)\bextends\s+([\w.]+)")).alias("extends"), F.coalesce(names, F.array().cast("array<string>")).alias("implements"),
        F.when(~is_class, part(rf"(?s)^{_MODIFIERS}++(?:<[^>]*>\s*)?(.*?)\s+\w+\s*\(")).alias("return_type"), F.when(~is_class, F.coalesce(part(r"(?s)\(([^)]*)\)"), F.lit(""))).alias("params"), "c.comment", "c.style",
    )


def annotations(sources: DataFrame) -> DataFrame:
    """(path, place, nth, annotation): the text of the annotations before each declaration of sources, in order, comments between them left out.

    Tokens are numbered by the barriers (other code) before them, so the notes of a declaration are those with its number.
    """
    found = sources.select("path", F.posexplode(all_of(F.col("text"), _TOKEN, 0)).alias("place", "t"))
    last = sources.agg(F.max(F.length("text"))).first()[0] or 0
    note = F.col("t").rlike(rf"(?s)^{_NOTE}$")
    head = F.col("t").rlike(rf"(?s)^(?:{_CLASS}|{_METHOD})$")
    comment = F.col("t").rlike(r"^(?:/\*|//)")
    rows = prefix.running_sum(found, ["path"], "place", (~note & ~comment).cast("int"), "group", last=last, unique=True)
    heads = rows.where(head).select("path", "group", F.col("place").alias("of"))
    notes = rows.where(note).join(heads, ["path", "group"])
    return notes.select("path", F.col("of").alias("place"), F.col("place").alias("nth"), F.col("t").alias("annotation"))


def comment_lines(comment: Column) -> Column:
    """Lines of a comment without its marks, blanks round them, and empty ones."""
    bare = F.regexp_replace(F.regexp_replace(comment, r"/\*\*?|\*/", ""), r"(?m)^[ \t]*//+", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\*\s?", ""), r"^\s+|\s+$", "")))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\*+$"))


def comment_fields(found: DataFrame) -> DataFrame:
    """(path, place, line, field, value) of the comments of declarations(): title, author, history, date, tag and body, as rows.

    The first labelled line is the title; without one the first line of at most 100 letters with Hangul or two capitals. A line with a history word starts a history, which a line that begins with a label in capitals ends; the lines
    between are its entries, and stand in no other field. Several fields may come from one line.
    """
    lines = found.where("comment is not null").select("path", "place", F.posexplode(comment_lines(F.col("comment"))).alias("line", "v"))
    heads = [F.nullif(F.trim(F.regexp_extract("v", rf"(?i){t}\s*[:=\-]\s*(.*)", 1)), F.lit("")) for t in TITLES]
    label = F.lower("v")
    starts = F.lit(False)
    for word in HISTORIES:
        starts = starts | label.contains(word)
    rows = lines.withColumn("head", F.coalesce(*heads)).withColumn("starts", starts).withColumn("stops", F.col("v").rlike(r"^[A-Z0-9]{2,}\b"))
    last = found.agg(F.max(F.length("comment"))).first()[0] or 0
    rows = prefix.as_of(rows, ["path", "place"], "line", F.when(F.col("starts"), "history").when(F.col("stops"), "other"), "under", last=last, unique=True)
    guess = F.when((F.length("v") <= 100) & F.col("v").rlike("[가-힣]|[A-Z]{2,}"), F.col("line"))
    first = rows.groupBy("path", "place").agg(F.min(F.when(F.col("head").isNotNull(), F.col("line"))).alias("head_line"), F.min(guess).alias("guess_line"))
    rows = rows.join(first, ["path", "place"])
    sure = lambda test: F.coalesce(test, F.lit(False))
    titled = sure(F.col("line") == F.col("head_line"))
    entry = sure(F.col("under") == "history") & ~F.col("starts") & ~F.col("stops") & ~titled
    guessed = F.col("head_line").isNull() & sure(F.col("line") == F.col("guess_line"))
    author = F.nullif(F.trim(F.regexp_extract("v", AUTHORS, 1)), F.lit(""))
    date = F.coalesce(*(F.nullif(F.regexp_extract("v", f"({d})", 1), F.lit("")) for d in DATES))
    free = ~titled & ~entry
    one = lambda field, test, value: F.when(test, F.struct(F.lit(field).alias("field"), value.alias("value")))
    fields = F.array_compact(F.array(
        one("title", titled, F.col("head")), one("title", guessed, F.col("v")), one("history", entry, F.col("v")), one("author", free & author.isNotNull(), author),
        one("date", free & date.isNotNull(), date), one("tag", free & F.col("v").rlike(r"(?i)\b(?:TODO|FIXME|NOTE)\b"), F.col("v")), one("body", free & ~guessed, F.col("v")),
    ))
    return rows.select("path", "place", "line", F.explode(fields).alias("f")).select("path", "place", "line", "f.*")
