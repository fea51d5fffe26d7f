"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text (UTF-8) wherever its low bits are all ones; k bits make pieces of 2^k bytes on
average. The cuts of k + 1 bits are among those of k bits, so one pass tells all block sizes. A fingerprint takes the least k that
leaves at most 64 pieces, by count, and has three signatures, of k, k + 1 and k + 2: twelve bits of the hash of each piece's bytes as
two letters. A change in a text changes the pieces it touches and leaves the others.

Two fingerprints are likened at block sizes that both have: 1 - d / (sum of lengths), d being the edit distance of the
signatures in insertions and deletions (a replacement is one of each); of several common block sizes the largest value, without
one 0. Equal fingerprints are 1, so two empty texts are too; one empty text and another are 0.

Edge cases: null is the empty text, with fingerprint ``2:::``; texts of any length are read in blocks of 1 MB with one byte of memory a byte
of text; equal texts have equal fingerprints. No piece is dropped or folded. A text that is one short word over and over is cut at every
word or nowhere, so half of it may have no block size in common with the whole.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, enter, mix

ROLL = 7
PIECES = 64
SIGNATURES = 3
LEAST_BITS = 2
BLOCK_BYTES = 1 << 20
#: Odd multiplier of the piece hash and its inverse modulo 2^64.
FACTOR = 0xD6E8FEB86659FD93
BACK = pow(FACTOR, -1, 1 << 64)
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SYMBOLS = [(_LETTERS[i >> 6 : (i >> 6) + 1] + _LETTERS[i & 63 : (i & 63) + 1]).decode() for i in range(4096)]
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables["roll"] = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
        _tables["byte"] = mix(np.arange(1001, 1257, dtype=np.uint64))
        for key, base in (("power", FACTOR), ("back", BACK)):
            power = np.full(BLOCK_BYTES, base, np.uint64)
            power[0] = 1
            _tables[key] = np.multiply.accumulate(power)
    return _tables[name]


def levels(data: np.ndarray) -> np.ndarray:
    """How many low bits of the rolling hash are ones after each byte; 0 for less than LEAST_BITS."""
    out, value = np.zeros(len(data), np.uint8), _table("roll")
    for lo in range(0, len(data), BLOCK_BYTES):
        b = value[data[max(0, lo - ROLL + 1) : lo + BLOCK_BYTES]]
        h = b.copy()
        for i in range(1, ROLL):
            h[i:] += b[:-i] * np.uint32(0x01000193**i & 0xFFFFFFFF)
        h = h[len(h) - min(BLOCK_BYTES, len(data) - lo) :]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        # the lowest zero bit as a power of two: its exponent is what float gives; fewer bits than count aren't told apart
        some = np.flatnonzero(h & np.uint32((1 << LEAST_BITS) - 1) == (1 << LEAST_BITS) - 1)
        low = ~h[some] & (h[some] + np.uint32(1))
        out[lo + some] = np.where(low == 0, 32, np.frexp(low.astype(np.float64))[1] - 1)
    return out


def _prefix(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of (hash of byte i) * FACTOR^i over the bytes before each place, modulo 2^64; places in order."""
    value, power, out, before, base = _table("byte"), _table("power"), [], np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for lo in range(0, len(data), BLOCK_BYTES):
        b = value[data[lo : lo + BLOCK_BYTES]]
        sums = before + base * np.cumsum(b * power[: len(b)])
        out.append(sums[at[(at > lo) & (at <= lo + BLOCK_BYTES)] - lo - 1])
        before, base = sums[-1:], base * (power[-1:] * np.uint64(FACTOR))
    return np.concatenate(out)


def _back(places: np.ndarray) -> np.ndarray:
    """FACTOR^-place modulo 2^64."""
    whole, rest = np.divmod(places, BLOCK_BYTES)
    out = _table("back")[rest]
    if whole.any():
        out *= np.array([pow(BACK, BLOCK_BYTES * int(k), 1 << 64) for k in whole], np.uint64)
    return out


def signature(cuts: np.ndarray, sums: np.ndarray) -> str:
    """Two letters for each piece between cuts, by the sums before them."""
    start, before = np.concatenate(([0], cuts[:-1])), np.concatenate((np.zeros(1, np.uint64), sums[:-1]))
    pieces = (sums - before) * _back(start) * np.uint64(0x9E3779B97F4A7C15)
    return "".join([_SYMBOLS[i] for i in (pieces >> np.uint64(52)).tolist()])


def fingerprint(text: str | None) -> str:
    """bits:signature, and the signatures of more bits after colons."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return f"{LEAST_BITS}{':' * SIGNATURES}"
    level = levels(data)
    level[-1] = 64  # the last piece ends with the text
    counts = np.bincount(level, minlength=65)[::-1].cumsum()[::-1]
    bits = next(k for k in range(LEAST_BITS, 65) if counts[k] <= PIECES)
    cuts = np.flatnonzero(level >= bits)
    of, cuts = level[cuts], cuts + 1
    sums = _prefix(data, cuts)
    return ":".join([str(bits), *(signature(cuts[of >= bits + i], sums[of >= bits + i]) for i in range(SIGNATURES))])


def edits(a: list[str], b: list[str]) -> int:
    """Edit distance in insertions and deletions, a row of the table as the bits of one integer."""
    place: dict[str, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        both = row & place.get(y, 0)
        if both:
            row = ((row + both) | (row - both)) & full
    return row.bit_count() * 2 + len(b) - len(a)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    best = 0.0
    x, y = ({int(k) + i: s for i, s in enumerate(parts)} for k, *parts in (a.split(":"), b.split(":")))
    for k in x.keys() & y.keys():
        p, q = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (x[k], y[k]))
        if p and q:
            best = max(best, 1 - edits(p, q) / (len(p) + len(q)))
    return best


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and the fingerprint of each text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enter("piecewise", _tables.clear)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([fingerprint(t.as_py()) for t in b.column("_text")], pa.string())], names=["_id", "fingerprint"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, fingerprint string")
    return out.withColumnRenamed("_id", id_col)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first code points of the other, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of the text edited with the next document's, and how near both and the next text are.

    Next is by descending id (null ids last, equal ids by hash of the text); after the last comes the first. Texts are moved once, into
    ranges of that order; a range hands over its first text and its last row, and only these, two a range, are looked at again to join the
    ranges. Rows equal in id and text stay in one range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "piecewise")
    order = [F.desc_nulls_last("doc_id"), "_x"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_x", F.xxhash64("_text"))
    names = [f.split()[0] for f in ROW.split(", ")]
    more = ["_end", "_part", "_text"]

    def row(doc_id, text: str, mark: str, following: str, its_mark: str) -> tuple:
        new = edited(text, following)
        new_mark = fingerprint(new)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, its_mark)

    def run(batches):
        enter("piecewise", _tables.clear)
        part = uuid.uuid4().hex
        held, blank = None, (None,) * len(names)
        for b in batches:
            out: list[tuple] = []
            for doc_id, t in zip(b.column("doc_id"), b.column("_text")):
                text = t.as_py()
                mark = fingerprint(text)
                if held is None:
                    out.append((doc_id.as_py(), *blank[1:3], mark, *blank[4:], "first", part, text))
                else:
                    out.append((*row(*held, text, mark), None, None, None))
                held = doc_id.as_py(), text, mark
            yield rows_of(out, b.schema.field("doc_id").type)
        if held:
            yield rows_of([(held[0], *blank[1:3], held[2], *blank[4:], "last", part, held[1])], b.schema.field("doc_id").type)

    def rows_of(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.string()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=[*names, *more])

    def join(batches):
        enter("piecewise", _tables.clear)
        for b in batches:
            got = b.to_pylist()
            yield rows_of([(*row(r["doc_id"], r["_text"], r["fingerprint"], r["_next"], r["_mark"]), None, None, None) for r in got], b.schema.field("doc_id").type).select(names)

    schema = ROW.format(kind=kind)
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "_text")
    found = scratch.keep(ranges.mapInArrow(run, f"{schema}, _end string, _part string, _text string"))
    ends = found.where("_end is not null").withColumn("_x", F.xxhash64("_text"))
    # two rows a range, in order; the first text of the next range, or of all ranges, goes to each last row
    first = ends.where("_end = 'first'").select(F.col("doc_id").alias("_id"), "_x", "_part")
    ring = Window.orderBy(F.desc_nulls_last("_id"), "_x")
    follow = first.select("_part", F.coalesce(F.lead("_part").over(ring), F.first("_part").over(ring)).alias("_to"))
    heads = ends.where("_end = 'first'").select(F.col("_part").alias("_to"), F.col("_text").alias("_next"), F.col("fingerprint").alias("_mark"))
    last = ends.where("_end = 'last'").join(follow, "_part").join(heads, "_to").select("doc_id", "_text", "fingerprint", "_next", "_mark")
    out = found.where("_end is null").select(*names).unionByName(last.mapInArrow(join, schema))
    return out.withColumnRenamed("doc_id", id_col)
