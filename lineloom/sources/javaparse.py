"""Java sources as tables: types, methods, calls. A light scanner over tokens; what it can't read it skips.

Nested types are types of their own. Generic arguments stay in the types as written, without blanks. Edge cases: a null or
empty text has no types; a file that ends inside a body gives what stands before; rows are judged one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"{3}.*?\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>::|->|\.\.\.|.)""",
    re.DOTALL,
)
#: Words of the language that name no method, variable or type.
_RESERVED = set("if for while switch catch return synchronized new super this throw else do try finally assert case default break continue instanceof yield package import".split())
_MODIFIERS = set("public protected private static final abstract native strictfp transient volatile synchronized default sealed".split())
_KINDS = ("class", "interface", "enum", "record")


@dataclass
class Token:
    text: str
    kind: str
    line: int


@dataclass
class Method:
    name: str
    annotations: list[str]
    modifiers: list[str]
    return_type: str
    params: list[tuple[str, str]]
    locals: list[tuple[str, str]]
    calls: list[str]
    start_line: int
    end_line: int


@dataclass
class Type:
    name: str
    kind: str
    annotations: list[str]
    superclass: str | None = None
    interfaces: list[str] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)
    start_line: int = 0
    end_line: int = 0


def tokens(source: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        if m.lastgroup != "skip":
            out.append(Token(m.group(), m.lastgroup, line))
        line += m.group().count("\n")
    return out


class Parser:
    def __init__(self, source: str):
        self.t = tokens(source) + [Token("", "end", 0)]
        self.at = 0
        self.package, self.imports, self.types = "", [], []

    def text(self, ahead: int = 0) -> str:
        return self.t[min(self.at + ahead, len(self.t) - 1)].text

    def word(self, ahead: int = 0) -> bool:
        return self.t[min(self.at + ahead, len(self.t) - 1)].kind == "word"

    def close(self, at: int, open_: str, shut: str) -> int:
        """Place of what closes the bracket at `at`; the end if nothing does."""
        depth = 0
        for i in range(at, len(self.t)):
            depth += (self.t[i].text == open_) - (self.t[i].text == shut)
            if depth == 0:
                return i
        return len(self.t) - 1

    def name(self) -> str:
        parts = [self.text()]
        self.at += 1
        while self.text() == "." and self.word(1):
            parts.append(self.text(1))
            self.at += 2
        return ".".join(parts)

    def type(self) -> str | None:
        """A type as written, or nothing (and no step) where none stands."""
        start = self.at
        if not self.word() or self.text() in _RESERVED:
            return None
        out = self.name()
        if self.text() == "<":
            end = self.close(self.at, "<", ">")
            inner = self.t[self.at : end + 1]
            if any(x.text in (";", "{", "(", "&&", "=") for x in inner) or end == len(self.t) - 1:
                self.at = start
                return None
            out += "".join(f" {x.text} " if x.text in ("extends", "super") else x.text for x in inner)
            self.at = end + 1
            while self.text() == "." and self.word(1):
                out += "." + self.text(1)
                self.at += 2
        while self.text() == "[" and self.text(1) == "]":
            out, self.at = out + "[]", self.at + 2
        if self.text() == "...":
            out, self.at = out + "[]", self.at + 1
        return out

    def heading(self) -> tuple[list[str], list[str]]:
        """Annotations and modifiers, in any order."""
        notes, modifiers = [], []
        while True:
            if self.text() == "@" and self.word(1) and self.text(1) != "interface":
                self.at += 1
                note = "@" + self.name()
                if self.text() == "(":
                    end = self.close(self.at, "(", ")")
                    note += "".join(x.text + (" " if x.text == "," else "") for x in self.t[self.at : end + 1])
                    self.at = end + 1
                notes.append(note)
            elif self.text() in _MODIFIERS:
                modifiers.append(self.text())
                self.at += 1
            else:
                return notes, modifiers

    def unit(self) -> Parser:
        while self.at < len(self.t) and self.t[self.at].kind != "end":
            if self.text() == "package":
                self.at += 1
                self.package = self.name()
            elif self.text() == "import":
                self.at += 1
                static = self.text() == "static"
                self.at += static
                name = self.name()
                if self.text() == ".":
                    name, self.at = name + ".*", self.at + 2
                if self.package:  # imports of a unit without package are not listed
                    self.imports.append(name)
            else:
                notes, _ = self.heading()
                if not self.declaration(notes):
                    self.at += 1
        return self

    def declaration(self, notes: list[str]) -> bool:
        """Reads the type declaration that stands here, if one does."""
        if self.text() == "@" and self.text(1) == "interface":
            self.at += 1
        if self.text() not in _KINDS or not self.word(1) or (self.text() == "record" and self.text(2) not in ("(", "<")):
            return False
        own = Type(self.text(1), self.text(), notes, start_line=self.t[self.at].line)
        self.at += 2
        if self.text() == "<":
            self.at = self.close(self.at, "<", ">") + 1
        if self.text() == "(":
            own.fields += self.parameters()
        while self.text() not in ("{", ";", ""):
            what = self.text()
            self.at += 1
            found = []
            while what in ("extends", "implements", "permits") and (t := self.type()):
                found.append(re.sub(r"<.*", "", t))
                if self.text() != ",":
                    break
                self.at += 1
            if what == "extends" and own.kind == "class":
                own.superclass = found[0] if found else None
            elif what in ("extends", "implements"):
                own.interfaces += found
        self.types.append(own)
        if self.text() == "{":
            end = self.close(self.at, "{", "}")
            self.at += 1
            if own.kind == "enum":  # constants first
                while self.at < end and self.text() != ";":
                    skip = {"(": ")", "{": "}"}.get(self.text())
                    self.at = self.close(self.at, self.text(), skip) + 1 if skip else self.at + 1
            while self.at < end:
                self.member(own, end)
            self.at = end + 1
            own.end_line = self.t[end].line
        return True

    def parameters(self) -> list[tuple[str, str]]:
        """(type, name) pairs in the brackets that open here."""
        end, out = self.close(self.at, "(", ")"), []
        self.at += 1
        while self.at < end:
            self.heading()
            kind = self.type()
            if kind and self.word():
                name, self.at = self.text(), self.at + 1
                while self.text() == "[" and self.text(1) == "]":
                    kind, self.at = kind + "[]", self.at + 2
                out.append((kind, name))
            else:
                self.at += 1
        self.at = end + 1
        return out

    def member(self, own: Type, end: int) -> None:
        start = self.t[self.at].line
        notes, modifiers = self.heading()
        if self.declaration(notes):
            return
        if self.text() == "{":
            self.at = self.close(self.at, "{", "}") + 1
            return
        if self.text() == "<":
            self.at = self.close(self.at, "<", ">") + 1
        kind = self.type()
        if kind and self.word() and self.text(1) == "(":
            name, self.at = self.text(), self.at + 1
            params = self.parameters()
            while self.text() not in ("{", ";", "") and self.at < end:
                self.at += 1
            stop = self.close(self.at, "{", "}") if self.text() == "{" else self.at
            own.methods.append(Method(name, notes, modifiers, kind, params, self.variables(self.at + 1, stop), self.calls(self.at + 1, stop), start, self.t[stop].line))
            self.at = stop + 1
        elif kind and self.text() == "(":  # a constructor is no method
            self.parameters()
            while self.text() not in ("{", ";", "") and self.at < end:
                self.at += 1
            self.at = (self.close(self.at, "{", "}") if self.text() == "{" else self.at) + 1
        elif kind and self.word():
            while self.word() and self.at < end:
                own.fields.append((kind, self.text()))
                self.at += 1
                while self.at < end and self.text() not in (",", ";"):
                    shut = {"(": ")", "{": "}", "[": "]"}.get(self.text())
                    self.at = self.close(self.at, self.text(), shut) + 1 if shut else self.at + 1
                self.at += 1
                if self.t[self.at - 1].text == ";":
                    return
        else:
            self.at += 1

    def variables(self, lo: int, hi: int) -> list[tuple[str, str]]:
        """(type, name) of local variables between two places: a type and a name at the start of a statement or a head."""
        out, back = [], self.at
        for i in range(lo, hi):
            before = self.t[i - 1].text
            if before in (";", "{", "}", "(", "final") or (before == ")" and self.t[i].kind == "word"):
                self.at = i
                kind = self.type()
                if kind and self.word() and self.text() not in _RESERVED and self.text(1) in ("=", ";", ":", ",", "["):
                    if before != "(" or self.t[i - 2].text in ("for", "try"):
                        out.append((kind, self.text()))
        self.at = back
        return out

    def receiver(self, at: int) -> list[str]:
        """Names before the dot behind `at`; results of calls stand for what they were called on."""
        t = self.t[at]
        if t.text == ")":
            depth = 0
            for i in range(at, -1, -1):
                depth += (self.t[i].text == ")") - (self.t[i].text == "(")
                if depth == 0:
                    break
            i -= 1
            if self.t[i].text == ">":
                while i > 0 and self.t[i].text != "<":
                    i -= 1
                i -= 1
            if i < 0 or self.t[i].kind != "word" or self.t[i].text in _RESERVED - {"super", "this"}:
                return []
            start = i
            while self.t[start - 1].text == "." and self.t[start - 2].kind == "word":
                start -= 2
            if self.t[start - 1].text == "new":
                return [self.t[i].text]
            return self.receiver(i - 2) if self.t[i - 1].text == "." else []
        if t.kind != "word" or t.text in ("this", "super"):
            return []
        return (self.receiver(at - 2) if self.t[at - 1].text == "." else []) + [t.text]

    def calls(self, lo: int, hi: int) -> list[str]:
        out = []
        for i in range(lo, hi):
            if self.t[i].text == "(" and self.t[i - 1].kind == "word" and self.t[i - 1].text not in _RESERVED:
                before = self.t[i - 2].text
                start = i - 1
                while self.t[start - 1].text == "." and self.t[start - 2].kind == "word":
                    start -= 2
                if self.t[start - 1].text in ("new", "@"):
                    continue
                out.append(".".join([*(self.receiver(i - 3) if before == "." else []), self.t[i - 1].text]))
        return out


_PAIR = "array<struct<type:string,name:string>>"
TYPES = f"path string, package string, class_name string, full_name string, kind string, superclass string, interfaces array<string>, annotations array<string>, imports array<string>, fields {_PAIR}, start_line int, end_line int, methods array<struct<name:string,annotations:array<string>,modifiers:array<string>,return_type:string,params:{_PAIR},locals:{_PAIR},calls:array<string>,start_line:int,end_line:int>>"


def types(sources: DataFrame) -> DataFrame:
    """TYPES of sources (path, text): one row for each class, interface, enum and record, with its methods."""
    pair = pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))
    words = pa.list_(pa.string())
    method = pa.struct([("name", pa.string()), ("annotations", words), ("modifiers", words), ("return_type", pa.string()), ("params", pair), ("locals", pair), ("calls", words), ("start_line", pa.int32()), ("end_line", pa.int32())])
    schema = pa.schema([*((c, pa.string()) for c in ("path", "package", "class_name", "full_name", "kind", "superclass")), ("interfaces", words), ("annotations", words), ("imports", words), ("fields", pair), ("start_line", pa.int32()), ("end_line", pa.int32()), ("methods", pa.list_(method))])
    pairs = lambda x: [{"type": t, "name": n} for t, n in x]

    def rows(path, text):
        unit = Parser(text or "").unit()
        for t in unit.types:
            methods = [vars(m) | {"params": pairs(m.params), "locals": pairs(m.locals)} for m in t.methods]
            own = {k: v for k, v in vars(t).items() if k != "name"} | {"fields": pairs(t.fields), "methods": methods}
            yield own | {"path": path, "package": unit.package, "class_name": t.name, "full_name": f"{unit.package}.{t.name}".lstrip("."), "imports": unit.imports}

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                out = [r for p, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows(p, x)]
                yield pa.RecordBatch.from_pylist(out, schema)

    return sources.select("path", "text").mapInArrow(run, TYPES)


def methods(found: DataFrame) -> DataFrame:
    """One row for each method of types()."""
    from pyspark.sql import functions as F

    return found.select("path", "package", "class_name", "full_name", "kind", F.posexplode("methods").alias("place", "m")).select("path", "package", "class_name", "full_name", "kind", "place", "m.*")
