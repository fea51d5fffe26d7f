"""Benchmark decontamination with an FM-index per training shard.

Benchmark windows (13 words, or a whole shorter item) are the patterns. A shard is a bounded run of documents of one
task. All its words are numbered by a vocabulary of its own; over them, with a separator after each document, stand a
suffix array, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All patterns whose words
the shard has are searched backward at once; occurrences are located by walking to the nearest sample; their word
ranges are merged into removal spans.

The benchmark is a stated query set: it is broadcast in blocks of at most ``block_words`` words and one item, each of which
meets all documents; spans of several blocks are merged by document. Edge cases: null or wordless text has no words, no
hits; an item without words has no window; a null item_id contaminates but is named in no list; repeated rows are
judged each by itself; very long texts are a shard of their own; other columns are kept or ignored (keep_clean keeps any).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, enter

WINDOW = 13
SHARD_WORDS = 600_000
BLOCK_WORDS = 1_000_000
SAMPLE = 8
#: A-Z to a-z; other ASCII that is no letter or digit to white space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class WaveletMatrix:
    """Rank over an integer sequence: one bit vector with prefix counts for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(at), at
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            bit = (symbol >> b) & 1
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            hi = np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of a sequence of symbols >= 1 in which 0 separates runs; it ends with 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        sa = self.suffixes(seq)
        before = seq[sa - 1]  # sa == 0 wraps to the final separator
        self.bwt = WaveletMatrix(before, max(1, int(seq.max()).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq))))
        start = np.concatenate(([True], seq[:-1] == 0))
        marked = (sa % sample == 0) | start[sa]
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples = sa[marked]
        self.n = len(seq)

    @staticmethod
    def suffixes(seq: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; separators are ordered by position, so each run ends all ties.

        The first sort takes as many symbols as fit 62 bits; later ones only what is not in place yet.
        """
        n, zero = len(seq), np.flatnonzero(seq == 0)
        rank = seq.astype(np.int64) + len(zero)
        rank[zero] = np.arange(len(zero))
        bits = max(1, int(rank.max()).bit_length())
        k = min(n, max(1, 62 // bits))
        key = rank.copy()
        for i in range(1, k):
            key <<= bits
            key[: n - i] |= rank[i:]
        # what follows a separator doesn't count
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = place
        while True:
            single = new & np.concatenate((new[1:], [True]))
            todo = np.flatnonzero(~single)
            if not len(todo):
                return order
            at = order[todo]
            key = rank[at] * n + rank[np.minimum(at + k, n - 1)]
            by = np.argsort(key, kind="stable")
            order[todo], key = at[by], key[by]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            new[todo] = first
            rank[order[todo]] = np.maximum.accumulate(np.where(first, todo, 0))
            k *= 2

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of the suffixes that start with each pattern (rows, right-aligned)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((step < length) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, width - 1 - step]
            known = c < len(self.first) - 1
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: steps back until a sampled suffix."""
        out, walked, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(todo):
            here = at[todo]
            hit = self.marks[here + 1] > self.marks[here]
            out[todo[hit]] = self.samples[self.marks[here[hit]]] + walked[todo[hit]]
            todo = todo[~hit]
            c = self.bwt.access(at[todo])
            at[todo] = self.first[c] + self.bwt.rank(c, at[todo])
            walked[todo] += 1
        return out


class Patterns:
    """Windows of benchmark items as symbol rows, with what tells that a document word can't be in one."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for name, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                owners.setdefault(tuple(ids[i : i + k]), set()).add(name)
        self.rows = list(owners)
        self.owners = [owners[r] for r in self.rows]
        self.length = np.array([len(r) for r in self.rows], np.int64)
        self.matrix = np.zeros((len(self.rows), max([1, *self.length])), np.int64)
        for i, r in enumerate(self.rows):
            self.matrix[i, self.matrix.shape[1] - len(r) :] = r


def merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of ranges [start, end), sorted; ranges that touch are joined."""
    out: list[list[int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def scan_shard(patterns: Patterns, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
    """(merged word spans, item ids) of each document (words)."""
    out: list[tuple[list, set]] = [([], set()) for _ in docs]
    size = np.array([len(d) + 1 for d in docs], np.int64)
    if not len(patterns.rows) or size.sum() == len(docs):
        return out
    number: dict[bytes, int] = {}
    give = number.setdefault
    flat = np.zeros(int(size.sum()), np.int64)
    start = np.cumsum(size) - size
    for d, s in zip(docs, start):
        flat[s : s + len(d)] = [give(w, len(number) + 1) for w in d]
    symbol = np.zeros(len(patterns.vocab) + 1, np.int64)
    symbol[1:] = [number.get(w, -1) for w in patterns.vocab]
    matrix = symbol[patterns.matrix]
    can = np.flatnonzero((matrix >= 0).all(1))
    if not len(can):
        return out
    length = patterns.length[can]
    index = FMIndex(flat)
    lo, hi = index.search(matrix[can], length)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pos = index.locate(rows)
    doc = np.searchsorted(start, pos, "right") - 1
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order], prepend=-1))
    for part in np.split(order, cuts[1:]) if len(order) else ():
        d = int(doc[part[0]])
        s = pos[part] - start[d]
        found: set = set()
        for i in np.unique(which[part]):
            found |= patterns.owners[can[i]]
        out[d] = (merge(s, s + length[which[part]]), found)
    return out


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        ws = words(r[1].encode())
        if not ws:
            continue
        block.append((r[0], ws))
        held += len(ws)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


_patterns: dict[tuple, Patterns] = {}


def _patterns_of(shared, window: int) -> Patterns:
    """Patterns of a broadcast block; a worker keeps those of the last one."""
    name, block = shared.value
    enter("decontaminate", _patterns.clear)
    if (name, window) not in _patterns:
        _patterns.clear()
        _patterns[name, window] = Patterns(block, window)
    return _patterns[name, window]


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, block_words: int) -> list:
    """Broadcasts of the benchmark's blocks, which are read one at a time; all of them stay with the executors until the scans end."""
    share = docs.sparkSession.sparkContext.broadcast
    return [share((uuid.uuid4().hex, x)) for x in _benchmark_blocks(benchmark, item_col, item_text, block_words)] or [share(("", []))]


def _scan(patterns: Patterns, texts: list[bytes | None], shard_words: int) -> tuple[list[int], list[tuple[list[tuple[int, int]], set]]]:
    """(words, scan_shard() rows) of texts, in shards of bounded size."""
    n_words, done, shard, held = [], [], [], 0
    for t in texts:
        ws = words(t)
        n_words.append(len(ws))
        if held and held + len(ws) > shard_words:
            done += scan_shard(patterns, shard)
            shard, held = [], 0
        shard.append(ws)
        held += len(ws)
    return n_words, done + scan_shard(patterns, shard)


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id, the columns of keep, n_words, n_hit, spans (merged word ranges [start, end)), items (ids with windows in it)."""
    key, passes = "_row", []
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    base = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"), *keep)
    blocks = _shared_blocks(docs, benchmark, item_col, item_text, block_words)
    if len(blocks) > 1:
        # written, as every pass must see the same numbers
        base = Scratch(docs.sparkSession, "decontaminate").keep(base.withColumn(key, F.monotonically_increasing_id()))
    carried = [id_col, *keep, *([key] if len(blocks) > 1 else [])]
    schema = ", ".join(f"`{c}` {'long' if c == key else kinds[c]}" for c in carried) + ", n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(block):
        def run(batches):
            patterns = _patterns_of(block, window)
            for b in batches:
                n_words, done = _scan(patterns, as_bytes(b.column("_text")), shard_words)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in carried), pa.array(n_words, pa.int64()), pa.array([[{"start": x, "end": y} for x, y in s] for s, _ in done], span), pa.array([sorted(x for x in i if x is not None) for _, i in done], pa.list_(pa.string()))],
                    names=[*carried, "n_words", "spans", "items"],
                )

        return run

    for block in blocks:
        passes.append(base.mapInArrow(scan(block), schema))
    out = passes[0]
    if len(blocks) > 1:
        for p in passes[1:]:
            out = out.unionByName(p)
        out = out.groupBy(key).agg(
            *(F.first(c).alias(c) for c in (id_col, *keep)), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        joined = """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (a, s) ->
            case when size(a) > 0 and s.start <= element_at(a, -1).end
                 then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end))))
                 else concat(a, array(s)) end)"""
        out = out.withColumn("spans", F.expr(joined))
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return out.select(id_col, *keep, "n_words", n_hit.alias("n_hit"), "spans", "items")


def contaminated(min_share: int = 20):
    """The contamination rule: any hit, and at least one word in min_share hit."""
    return (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs, as they are, that the benchmark doesn't contaminate; columns may have any names.

    A benchmark of one block decides on rows where they are; with more, spans() of all blocks are merged first.
    """
    blocks = _shared_blocks(docs, benchmark, "item_id", "text", block_words)
    if len(blocks) > 1:
        packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
        return spans(packed, benchmark, id_col="id", window=window, block_words=block_words, keep=("row",)).where(~contaminated()).select("row.*")
    at = docs.columns.index(text_col)

    def run(batches):
        patterns = _patterns_of(blocks[0], window)
        for b in batches:
            n, found = _scan(patterns, as_bytes(b.column(at)), SHARD_WORDS)
            hit = [sum(y - x for x, y in s) for s, _ in found]
            yield b.filter(pa.array([not (h and 20 * h >= w) for h, w in zip(hit, n)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(text: str, found: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    data, out, at = text.encode(), [], 0
    places = [(m.start(), m.end()) for m in _WORD.finditer(data.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))]
    for s, e in found:
        out.append(data[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, data[at:]]).decode()


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def report(found: DataFrame) -> DataFrame:
    """The query's digest columns of spans()."""
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
