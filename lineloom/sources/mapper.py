"""Statements of mapper XML files: one row a statement, dynamic tags resolved to one plain text."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VERBS = ("select", "insert", "update", "delete")
STATEMENT_SCHEMA = (
    "path string, namespace string, tag string, sql_id string, parameter_type string, result_type string, result_map string, sql string, resolved string, "
    "mappings array<struct<java_field:string,db_column:string>>, error string"
)


def local(el: ET.Element) -> str:
    return el.tag.rsplit("}", 1)[-1] if isinstance(el.tag, str) else ""


def texts(el: ET.Element) -> Iterator[str]:
    """Text pieces below an element in document order; a comment's own text is none, what follows it is one."""
    if local(el):
        yield el.text or ""
        for c in el:
            yield from texts(c)
            yield c.tail or ""


def flat(el: ET.Element) -> str:
    """All text below an element, pieces stripped and joined by a blank."""
    return " ".join(x for x in (t.strip() for t in texts(el)) if x)


class Resolver:
    """Plain text of a statement: every `if`, the first `when`, one pass of `foreach`, fragments put in."""

    def __init__(self, root: ET.Element):
        self.fragments = {e.get("id"): e for e in root.iter() if e.get("id") and local(e) in (*VERBS, "sql")}

    def body(self, el: ET.Element, inside: frozenset[str] = frozenset()) -> str:
        pieces = [el.text or ""] + [x for c in el for x in (self.piece(c, inside), c.tail or "")]
        return "".join(pieces)

    def piece(self, el: ET.Element, inside: frozenset[str]) -> str:
        kind = local(el)
        if not kind:
            return ""
        if kind == "include":
            ref = el.get("refid")
            if ref not in self.fragments:
                return f" /* MISSING INCLUDE: {ref} */ "
            return "" if ref in inside else self.body(self.fragments[ref], inside | {ref})
        if kind == "choose":
            ways = [c for want in ("when", "otherwise") for c in el if local(c) == want]
            return self.body(ways[0], inside) if ways else ""
        text = self.body(el, inside)
        if kind == "foreach":
            return f" {el.get('open', '')} {text} {el.get('close', '')} "
        text = text.strip() if kind in ("where", "set", "trim") else text
        if not text:
            return ""
        if kind == "where":
            return f" WHERE {re.sub(r'(?i)^(?:and|or)\s+', '', text)} "
        if kind == "set":
            return f" SET {text.removesuffix(',').rstrip()} "
        if kind == "trim":
            for attribute, cut in (("prefixOverrides", "(?i)^(?:{})"), ("suffixOverrides", "(?i)(?:{})$")):
                words = [re.escape(w.strip()) for w in el.get(attribute, "").split("|") if w.strip()]
                if words:
                    text = re.sub(cut.format("|".join(words)), "", text, count=1).strip()
            return f" {el.get('prefix', '')} {text} {el.get('suffix', '')} "
        return text


def parse(path: str, text: str | None) -> list[dict]:
    """Rows of one file; a file that isn't XML gives one row with its error."""
    blank = dict.fromkeys(("namespace", "tag", "sql_id", "parameter_type", "result_type", "result_map", "sql", "resolved", "error"), None) | {"path": path, "mappings": []}
    try:
        root = ET.fromstring(text or "", ET.XMLParser(target=ET.TreeBuilder(insert_comments=True)))
    except ET.ParseError as e:
        return [blank | {"error": str(e)}]
    maps = {}
    for m in root.iter():
        if local(m) == "resultMap":
            pairs = [c for want in ("result", "id") for c in m.iter() if local(c) == want]
            maps[m.get("id")] = m.get("type"), [{"java_field": c.get("property"), "db_column": c.get("column")} for c in pairs]
    resolver, rows = Resolver(root), []
    for verb in VERBS:
        for el in root.iter():
            if local(el) != verb or not el.get("id") or not flat(el):
                continue
            kind, pairs = maps.get(el.get("resultMap"), (None, []))
            rows.append(
                {
                    "path": path, "namespace": root.get("namespace"), "tag": verb, "sql_id": el.get("id"), "parameter_type": el.get("parameterType"),
                    "result_type": el.get("resultType") or kind, "result_map": el.get("resultMap"), "sql": flat(el),
                    "resolved": " ".join(resolver.body(el, frozenset({el.get("id")})).split()), "mappings": pairs if verb == "select" else [], "error": None,
                }
            )
    return rows


def statements(files: DataFrame) -> DataFrame:
    """Statements of files (path, text); see STATEMENT_SCHEMA. Null or broken text gives one row with the error."""
    pair = pa.list_(pa.struct([("java_field", pa.string()), ("db_column", pa.string())]))
    names = [x.split()[0] for x in re.split(r",\s(?=\w+ )", STATEMENT_SCHEMA)]
    schema = pa.schema([(n, pair if n == "mappings" else pa.string()) for n in names])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [r for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in parse(p, t)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "text").mapInArrow(run, STATEMENT_SCHEMA)
