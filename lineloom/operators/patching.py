"""Changes proposed for source files: reading them out of answers and applying them.

Three forms: a whole new text, a unified diff, blocks of SEARCH and REPLACE. Files are judged one by one, so all is map only.
Nothing is written to the files; the patched texts are a column. A null text is empty, a null change changes nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks of the forms, and what a line that may be passed over starts with.
FILE, REASON, CODE, END = (f"======{x}======" for x in ("FILE", "REASON", "MODIFIED_CODE", "END"))
SEARCH, BETWEEN, REPLACE = "<<< SEARCH", "===", ">>> REPLACE"
PASSED_OVER = ("//", "#", "/*", "*")

_PIECE = re.compile(r"^--- (?P<old>[^\n]*)\n\+\+\+ (?P<new>[^\n]*)$|^[^\S\n]*@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(?P<section>[^\n]*)$", re.M)
_mark = lambda m: rf"^[^\S\n]*{re.escape(m)}[^\S\n]*(?:\n|\Z)"
_BLOCK = re.compile(f"{_mark(SEARCH)}(.*?){_mark(BETWEEN)}(.*?){_mark(REPLACE)}", re.M | re.S)
_HUNKS = "array<struct<old_path:string,new_path:string,old_start:int,old_count:int,new_start:int,new_count:int,section:string,lines:array<string>>>"


@dataclass
class Hunk:
    """lines keep their mark: a blank for context, - and +."""

    old_path: str
    new_path: str
    old_start: int
    old_count: int
    new_start: int
    new_count: int
    section: str | None
    lines: list[str] = field(default_factory=list)


def hunks(diff: str) -> list[Hunk]:
    """Hunks of a unified diff; without file headers the paths are /dev/null; counts left out are 1; an empty line is context.

    The diff is cut at file headers and hunk heads; of what stands between, the lines with a mark belong to the hunk. Counts aren't relied on,
    as answers get them wrong, so a line `--- x` before one `+++ y` is always a file header.
    """
    pieces = list(_PIECE.finditer("\n".join(diff.splitlines())))
    ends = [m.start() for m in pieces[1:]] + [len(diff)]
    out: list[Hunk] = []
    paths = "/dev/null", "/dev/null"
    for m, end in zip(pieces, ends):
        if m["old"] is not None:
            paths = m["old"].strip(), m["new"].strip()
            continue
        numbers = [int(x or 1) for x in m.group(3, 4, 5, 6)]
        body = m.string[m.end() : end].split("\n")[1:]
        body = body[:-1] if end < len(m.string) else body
        out.append(Hunk(*paths, *numbers, m["section"].strip() or None, [x or " " for x in body if x[:1] in ("", " ", "-", "+")]))
    return out


class Lines:
    """A text's lines without trailing blanks: where each stands, and for each place the next line that may not be passed over."""

    def __init__(self, raw: list[str]):
        self.places: dict[str, list[int]] = {}
        self.solid = [len(raw)] * (len(raw) + 1)
        for i in range(len(raw) - 1, -1, -1):
            line = raw[i].rstrip()
            self.places.setdefault(line, []).append(i)
            head = line.lstrip()
            self.solid[i] = self.solid[i + 1] if not head or head.startswith(PASSED_OVER) else i
        for found in self.places.values():
            found.reverse()

    def next(self, line: str, at: int) -> int | None:
        """Where the line stands first at or after a place."""
        found = self.places.get(line, [])
        k = bisect_left(found, at)
        return found[k] if k < len(found) else None

    def chain(self, wanted: list[str], at: int) -> list[int] | None:
        """Places of wanted lines from `at` on, with nothing between that may not be passed over; None: not here."""
        out: list[int] = []
        for w in wanted:
            place = self.next(w, at)
            if place is None or place > self.solid[at]:
                return None
            out.append(place)
            at = place + 1
        return out

    def fit(self, wanted: list[str], least: int, hint: int) -> tuple[int, list[int]] | None:
        """(start, places) of wanted lines: at the hint if they fit there, else at the first start from `least` on.

        A start is a place from which only lines that may be passed over lead to the first wanted line, so all starts before an occurrence
        of that line, back to the solid line before it, have its chain: only the first of them counts.
        """
        if hint >= least and hint <= len(self.solid) - 1 and (there := self.chain(wanted, hint)):
            return hint, there
        first = self.next(wanted[0], least)
        while first is not None:
            if there := self.chain(wanted, first):
                start = first
                while start > least and self.solid[start - 1] != start - 1:
                    start -= 1
                return start, there
            first = self.next(wanted[0], first + 1)
        return None


def apply_hunks(text: str, found: list[Hunk]) -> tuple[str, list[int]]:
    """(patched text, old_start of the hunks that fit nowhere). Hunks apply by old_start, each at its line if it fits there, else at the first later place."""
    raw = text.splitlines(keepends=True)
    lines, done, rejected, out = Lines(raw), 0, [], []
    for h in sorted(found, key=lambda h: h.old_start):
        wanted = [x[1:].rstrip() for x in h.lines if x[0] != "+"]
        fit = lines.fit(wanted, done, h.old_start - 1) if wanted else (max(h.old_start - 1, done), [])
        if not fit:
            rejected.append(h.old_start)
            continue
        places = iter(fit[1])
        for line in h.lines:
            mark, rest = line[0], line[1:]
            upto = fit[0] if mark == "+" else next(places)
            out += raw[done : max(done, upto)]
            done = max(done, upto + (mark != "+"))
            out += [rest + "\n"] if mark != "-" else []
    return "".join(out + raw[done:]), rejected


def replace_last(text: str, old: str, new: str) -> str | None:
    """text with the last `old` replaced: as it stands, else without its last line ends, else lines compared without trailing blanks; None if it isn't there."""
    for x in (old, old.rstrip("\n")):
        head, hit, tail = text.rpartition(x) if x else ("", "", "")
        if hit:
            return head + new + tail
    raw, want = text.splitlines(keepends=True), [x.rstrip() for x in old.splitlines()]
    lines, n = [x.rstrip() for x in raw], len(want)
    at = next((i for i in range(len(lines) - n, -1, -1) if n and lines[i : i + n] == want), None)
    return None if at is None else "".join(raw[:at]) + new + "".join(raw[at + n :])


def patched(text: str, change: str, way: str) -> tuple[str, str | None, list[int]]:
    """(text after the change, what was wrong, rejected hunks); a change that is wrong leaves the text as it was."""
    if not change.strip():
        return text, None, []
    if way == "full":
        return change, None, []
    if way == "part":
        now = text
        for i, m in enumerate(_BLOCK.finditer(change), 1):
            step = replace_last(now, m[1], m[2])
            if step is None:
                return text, f"block {i} not found", []
            now = step
        return now, None, []
    if way == "diff":
        fenced = re.fullmatch(r"```[^\n]*\n(.*?)(?:```)?", change.strip(), re.S)
        found = hunks(fenced[1].strip() if fenced else change)
        if not found:
            return text, "no hunks", []
        if len({(h.old_path, h.new_path) for h in found}) > 1:
            return text, "several files", []
        now, rejected = apply_hunks(text, found)
        return now, None, rejected
    return text, f"unknown way {way}", []


def apply_changes(df: DataFrame, text: str = "text", change: str = "change", way: str = "way") -> DataFrame:
    """df with patch: struct (text, problem, rejected) of the change in each row; way is full, diff or part."""

    def run(t, c, w):
        import pandas as pd

        some = lambda x: x if isinstance(x, str) else ""
        rows = [patched(*map(some, x)) for x in zip(t, c, w)]
        return pd.DataFrame(rows, columns=["text", "problem", "rejected"])

    return df.withColumn("patch", F.pandas_udf(run, "text string, problem string, rejected array<int>")(text, change, way))


def diff_hunks(df: DataFrame, diff: str = "diff") -> DataFrame:
    """One row for each hunk of the diffs: the columns of df, place (of the hunk in its diff), and those of Hunk in the struct hunk."""

    def run(d):
        import pandas as pd

        return pd.Series([[vars(h) for h in hunks(x)] if isinstance(x, str) else [] for x in d])

    return df.select("*", F.posexplode(F.pandas_udf(run, _HUNKS)(diff)).alias("place", "hunk"))


def answers(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each block of delimited answers: the columns of df, place, and struct change (name, reason, code).

    A block without a file mark is none; what lacks its mark is empty, and ends with the next mark that is there.
    """
    blocks = F.filter(F.split(text, END), lambda b: b.contains(FILE))

    def section(b, start, *ends):
        rest = F.get(F.split(b, start, 2), F.lit(1))
        for e in ends:
            rest = F.substring_index(rest, e, 1)
        rest = F.coalesce(rest, F.lit(""))
        return F.regexp_replace(rest, r"^\s+|\s+$", "")

    found = F.transform(blocks, lambda b: F.struct(section(b, FILE, REASON, CODE).alias("name"), section(b, REASON, CODE).alias("reason"), section(b, CODE).alias("code")))
    return df.select("*", F.posexplode(found).alias("place", "change"))
