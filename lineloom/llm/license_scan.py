"""License scans by conditional compression.

In candidate blocks (runs of lines that share the words of licence texts) every template is looked for whose telling
words (names, versions) stand close enough together, and confirmed by exact wording: a template is found if its words
stand in the block in order, with at most ``max_edits`` of them missing or put between and the telling words all
present. Of readings that share words of the block, those with the fewest differences count. Each is compressed, with
at most MARGIN characters around it, alone and with its template as a raw zstandard dictionary; what that saves is
reported and orders the readings, but doesn't decide.

Edge cases: null and empty texts have no blocks; ties in what is saved go to the longer, then the first template; a
notice that a block has several times is reported each time, as are repeated rows; a notice over several lines has the
number of its first; very long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notices by which texts declare a licence, and words that a match may not lack.
TEMPLATES = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted free charge copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution source binary permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "waived copyright rights"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
]
#: A line is of interest if it has one of these, which every template has.
MARK = r"(?i)licen[sc]e|permission|redistribution|copyright|public\s+domain"
#: Characters on each side of a notice that are compressed with it.
MARGIN = 100
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES, level: int = 3):
        import zstandard

        self.templates = [(name, text, words(text), set(words(must))) for name, text, must in templates]
        self.vocab = {w for _, _, ws, _ in self.templates for w in ws}
        self.alone = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, t, _, _ in self.templates
        ]
        self.seen: dict[str, list] = {}

    def saved(self, window: str, i: int) -> float:
        """Share of the compressed size that the template saves."""
        data = window.encode("utf-8", "replace")
        return 1 - len(self.given[i].compress(data)) / len(self.alone.compress(data))

    def align(self, have: list[str], i: int, most: int) -> tuple[int, int, int, int] | None:
        """(template words missing, words put between, first, last) of the reading with the fewest of both, if at most `most`."""
        _, _, want, must = self.templates[i]
        bit = {w: 1 << k for k, w in enumerate(sorted(must))}
        whole = (1 << len(bit)) - 1
        best, ends = None, []
        for b, word in enumerate(have):
            new = []
            for a, w in enumerate(want):
                if w != word:
                    continue
                own = bit.get(w, 0)
                # telling words held -> (differences, missing, place of the first word): the template's words before are missing
                at = {own: (a, a, -b)} if a <= most else {}
                for a0, b0, held in ends:
                    if a0 < a and b0 < b:
                        gap, between = a - a0 - 1, b - b0 - 1
                        for m, (n, missing, first) in held.items():
                            to = (n + gap + between, missing + gap, first)
                            if to[0] <= most and to < at.get(m | own, (most + 1,)):
                                at[m | own] = to
                if at:
                    new.append((a, b, at))
                    if whole in at:
                        n, missing, first = at[whole]
                        rest = len(want) - 1 - a
                        got = (n + rest, missing + rest, first, b)
                        if got[0] <= most and (best is None or got < best):
                            best = got
            ends += new
        return best and (best[1], best[0] - best[1], -best[2], best[3])

    def readings(self, have: list[str], i: int, max_edits: float) -> set[tuple[int, int, int, int]]:
        """Where the template may stand: each place of its rarest telling word, with as many words around as a reading can have."""
        _, _, want, must = self.templates[i]
        places: dict[str, list[int]] = {w: [] for w in must}
        for b, w in enumerate(have):
            if w in places:
                places[w].append(b)
        rarest = min(sorted(must), key=lambda w: len(places[w]))
        most = int(max_edits * len(want))
        before, after = max(k for k, w in enumerate(want) if w == rarest) + most, len(want) - want.index(rarest) + most
        out = set()
        for b in places[rarest]:
            lo = max(0, b - before)
            part = have[lo : b + after]
            if must <= set(part) and (got := self.align(part, i, most)):
                out.add((got[0], got[1], lo + got[2], lo + got[3]))
        return out

    def scan(self, block: str, max_edits: float = 0.25) -> list[tuple[int, str, float, int, int]]:
        """(line within the block, licence, saved, missing, between) found in a block. Equal short blocks are worked out once."""
        got = self.seen.get(block)
        if got is None:
            low = block.lower()
            text = block if len(low) == len(block) else low
            at = list(_WORD.finditer(low))
            have, known = [m.group() for m in at], {m.group() for m in at}
            found = []
            for i, (name, t, _, must) in enumerate(self.templates):
                for missing, between, first, last in self.readings(have, i, max_edits) if must <= known else ():
                    lo, hi = at[first].start(), at[last].end()
                    saved = self.saved(text[max(0, lo - MARGIN) : hi + MARGIN], i)
                    found.append((missing + between, -saved, -len(t), i, first, last, name, missing, between, low.count("\n", 0, lo)))
            kept: list[tuple] = []
            for x in sorted(found):
                # of several readings of one notice, those with the fewest differences
                if not any(x[4] <= y[5] and y[4] <= x[5] and (y[0] < x[0] or y[6] == x[6]) for y in kept):
                    kept.append(x)
            got = [(x[9], x[6], -x[1], x[7], x[8]) for x in sorted(kept, key=lambda x: (x[4], x[1:4]))]
            if len(self.seen) > 50_000:
                self.seen.clear()
            if len(block) < 1000:
                self.seen[block] = got
        return got

    def blocks(self, text: str):
        """(number of the first line, block): maximal runs of lines with a mark, or mostly of template words."""
        mark, run, first = re.compile(MARK), [], 0
        for n, line in enumerate(text.split("\n")):
            ws = words(line)
            if ws and (mark.search(line) or 2 * sum(w in self.vocab for w in ws) > len(ws)):
                if not run:
                    first = n
                run.append(line)
                continue
            if run and mark.search(" ".join(run)):
                yield first, run
            run = []
        if run and mark.search(" ".join(run)):
            yield first, run


_scanner: list[Scanner] = []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license, saved, missing, between) for every licence notice found in docs."""

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        s = _scanner[0]
        for b in batches:
            rows = []
            for i, t in zip(b.column(0), b.column(1).to_pylist()):
                for first, lines in s.blocks(t):
                    rows += [(i, first + n, *x) for n, *x in s.scan("\n".join(lines))]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], kinds[0]), *(pa.array(list(c), k) for c, k in zip(cols[1:], kinds[1:]))], names=[id_col, "line", "license", "saved", "missing", "between"])

    marked = docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).where(F.col(text_col).rlike(MARK))
    return marked.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, line long, license string, saved double, missing long, between long")
