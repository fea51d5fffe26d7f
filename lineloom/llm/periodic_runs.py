"""Periodic runs of words in texts, by a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_repeats`` periods long, that
no neighbouring word extends keeping q. The states of the automaton are taken from long to short and each one's ordered set of
end positions is merged into that of its link, the smaller into the larger. A position that is put in next to another
one d away says that the state's longest word ends at both; with d not above the state's length they overlap or touch: a
square of period d. Squares are extended over the whole text as far as the period holds. For a run of period q the
last word of the run and the one q before meet first in the state of length (length - q), and as that is at least q, nothing
can stand between them: every run has its square.

Before that, words that can't be in a run are left out exactly: in a run of length >= r * q every window of
floor(min_length * (r - 2) / r) + 1 words comes again q words before or after, so only stretches of windows that are found twice
in the same stretch get an automaton. Windows meet as hashes, which can only let more through.

Documents are worked on where they are, without a shuffle. Edge cases: null, empty or wordless text has no words and no runs;
repeated rows are each worked on; a text of any length is one automaton a stretch, about 500 bytes a word of the stretch;
null ids are kept; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_WORDS, as_bytes, enter, mix

#: Positions in a block of an ordered set; at twice as many it is split.
BLOCK = 1024


class Ordered:
    """Ordered set of distinct positions in blocks, so that a new one moves at most a block."""

    __slots__ = ("blocks", "last", "size")

    def __init__(self, first: int):
        self.blocks, self.last, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, p: int) -> tuple[int | None, int | None]:
        """Put p in; the positions that stand before and after it."""
        k = bisect_left(self.last, p)
        self.size += 1
        if k == len(self.last):
            b = self.blocks[-1]
            before = b[-1]
            b.append(p)
            self.last[-1] = p
            after, k = None, k - 1
        else:
            b = self.blocks[k]
            i = bisect_left(b, p)
            before = b[i - 1] if i else self.last[k - 1] if k else None
            after = b[i]
            b.insert(i, p)
        if len(b) > 2 * BLOCK:
            self.blocks[k : k + 1] = [b[:BLOCK], b[BLOCK:]]
            self.last.insert(k, b[BLOCK - 1])
        return before, after


class Automaton:
    """Suffix automaton of a sequence of symbols: length and link of each state, and the end position that made it (-1: a copy)."""

    def __init__(self, symbols: list[int]):
        length, link, end, to = [0], [-1], [-1], [{}]
        last = 0
        for i, c in enumerate(symbols):
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            end.append(i)
            to.append({})
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = cur
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    end.append(-1)
                    to.append(to[q].copy())
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.length, self.link, self.end = length, link, end

    def squares(self, least: int) -> Iterator[tuple[int, int]]:
        """(end, d): the word ending at `end` and the one ending d before are the same, at least d and `least` symbols long."""
        length, link = self.length, self.link
        sets = [Ordered(e) if e >= 0 else None for e in self.end]
        order = np.argsort(-np.array(length), kind="stable")
        for v in order[: np.searchsorted(-np.array(length)[order], -least, "right")].tolist():
            u = link[v]
            most = length[u]
            if most < least:
                sets[v] = None
                continue
            mine, other = sets[v], sets[u]
            sets[v] = None
            if other is None:
                sets[u] = mine
                continue
            if mine.size > other.size:
                mine, other = other, mine
            for p in mine:
                before, after = other.add(p)
                if before is not None and p - before <= most:
                    yield p, p - before
                if after is not None and after - p <= most:
                    yield after, after - p
            sets[u] = other


def same_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the start of two arrays of one length are equal; looks at twice that many at most."""
    done, step = 0, 64
    while done < len(a):
        other = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(other):
            return done + int(other[0])
        done += step
        step *= 2
    return len(a)


def runs_of(ids: np.ndarray, stretches: list[tuple[int, int]], min_length: int = 24, min_repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the symbols `ids`, which lie inside `stretches` [start, end); by start, then period."""
    known: dict[int, tuple[list[int], list[int]]] = {}  # period: starts and ends of its runs, disjoint but for less than a period
    least = -(-min_length * (min_repeats - 1) // min_repeats)
    for lo, hi in stretches:
        for e, d in Automaton(ids[lo:hi].tolist()).squares(least):
            e += lo
            starts, ends = known.setdefault(d, ([], []))
            k = bisect_right(starts, e - d) - 1
            if k >= 0 and e <= ends[k]:
                continue
            # ids[i] == ids[i - d] holds round e
            right = same_for(ids[e + 1 :], ids[e + 1 - d : len(ids) - d])
            left = same_for(ids[d : e + 1][::-1], ids[: e + 1 - d][::-1])
            starts.insert(k + 1, e - left + 1 - d)
            ends.insert(k + 1, e + right)
    found: dict[tuple[int, int], int] = {}
    for d, (starts, ends) in known.items():
        for s, e in zip(starts, ends):
            if e - s + 1 >= max(min_length, min_repeats * d):
                found[s, e] = min(d, found.get((s, e), d))
    return sorted((s, e - s + 1, d) for (s, e), d in found.items())


def stretches(ids: np.ndarray, doc: np.ndarray, window: int, least: int) -> list[tuple[int, int]]:
    """[start, end) of stretches of a document whose every window of `window` words is found twice in the stretch, at least `least` words long.

    ids: words of documents, one after the other; doc: the number of each word's document.
    """
    n = len(ids) - window + 1
    if n <= 0:
        return []
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(window):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64))
        at = np.flatnonzero(doc[:n] == doc[window - 1 :])
        part = doc[at].astype(np.uint64)
        while True:
            key = mix(h[at] + part * np.uint64(0xC2B2AE3D27D4EB4F))
            order = np.argsort(key)
            equal = np.flatnonzero(key[order][1:] == key[order][:-1])
            again = np.zeros(len(at), bool)
            again[order[equal]] = again[order[equal + 1]] = True
            kept, part = at[again], part[again]
            cut = np.ones(len(kept), bool)
            cut[1:] = (np.diff(kept) > 1) | (part[1:] != part[:-1])
            number = np.cumsum(cut) - 1
            long = np.bincount(number, minlength=1)[number] + window - 1 >= least if len(kept) else np.zeros(0, bool)
            kept, number = kept[long], number[long]
            if len(kept) == len(at):
                break
            at, part = kept, number.astype(np.uint64)
    first = np.flatnonzero(np.diff(number, prepend=-1)) if len(kept) else []
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(kept, first[1:])] if len(kept) else []


def all_runs(docs: list[list[bytes]], min_length: int = 24, min_repeats: int = 3) -> list[list[tuple[int, int, int]]]:
    """runs_of() each list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    size = np.array([len(d) for d in docs], np.int64)
    number: dict[bytes, int] = {}
    give = number.setdefault
    ids = np.fromiter((give(w, len(number)) for d in docs for w in d), np.int64, int(size.sum()))
    doc, start = np.repeat(np.arange(len(docs)), size), np.cumsum(size) - size
    mine: dict[int, list] = {}
    for lo, hi in stretches(ids, doc, min_length * (min_repeats - 2) // min_repeats + 1, min_length):
        mine.setdefault(int(doc[lo]), []).append((lo, hi))
    for d, parts in mine.items():
        s = int(start[d])
        out[d] = runs_of(ids[s : s + size[d]], [(lo - s, hi - s) for lo, hi in parts], min_length, min_repeats)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """words joined by one space, without those that a run holds after its first period."""
    out, at = [], 0
    for lo, hi in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at:lo]
        at = max(at, hi)
    return b" ".join(out + words[at:])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_repeats: int = 3) -> DataFrame:
    """docs' id, n_words, runs (array of start, length, period, in words from 0, by start, then period) and collapsed, the text without
    what runs repeat. min_repeats: 2 or more."""
    if min_repeats < 2 or min_length < min_repeats:
        raise ValueError("a run repeats its period at least once")
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def chunks(b: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
        at, held, size = 0, [], 0
        for t in as_bytes(b.column("_text")):
            held.append((t or b"").split())
            size += len(held[-1])
            if size >= CHUNK_WORDS:
                yield at, held
                at, held, size = at + len(held), [], 0
        if held:
            yield at, held

    def work(batches):
        enter("periodic_runs")
        for b in batches:
            for at, words in chunks(b):
                found = all_runs(words, min_length, min_repeats)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("_id").slice(at, len(words)), pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found], run),
                        pa.array([collapsed(w, f) for w, f in zip(words, found)], pa.binary()).cast(pa.string()),
                    ],
                    names=["_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(work, f"_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("_id", id_col)


def repeated_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) in which one document of ten, by h = crc32 of the id, has its words from a = g % n repeat with period p = 1 + (n - a) div (3 + g % 8),
    g = h div 10, joined by one space; the others, those without words and those without an id stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), h.alias("_h"))
    words = F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("array_join(transform(sequence(0L, _n - 1), i -> _w[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_a").isNotNull(), tail).otherwise(F.col("_text")).alias(text_col))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's digest columns of find(): the strongest run, by exact length / period, then start, then period, and all runs as text."""
    strongest = F.expr("""array_sort(runs, (x, y) -> case when x.length * y.period > y.length * x.period then -1 when x.length * y.period < y.length * x.period then 1
        when x.start < y.start then -1 when x.start > y.start then 1 when x.period < y.period then -1 when x.period > y.period then 1 else 0 end)""")
    best = found.withColumn("_b", F.get(strongest, F.lit(0)))
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period", F.expr("1000 * _b.length div _b.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
