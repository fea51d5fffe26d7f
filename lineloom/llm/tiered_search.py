"""Ranked lexical search over a tiered index: high-impact postings first, residual bounds per term.

Documents are indexed in segments of bounded size, one row each, and a segment's postings stand in tiers, each a column of its own. A
posting's tier hangs on the score that it can give, its term's weight times its impact: the first tier has the postings
that can decide, the last those of common words. For each tier and term the segment keeps the residual bound, the largest impact in the tiers below.

A search reads the first tiers alone and takes from all segments the k best sums an item; the least of them is what a document must
reach. Then each segment goes through its tiers: a document's sum so far and the bounds of the terms it hasn't been seen with
say what it can reach. An item none of whose documents can reach what it must is done with the segment, which is the proof that the segment adds
nothing; an item that lacks it falls through to the next tier. What is left after the last tier is scored exactly. No candidates are cut off.

The items are a stated query set: they are taken in blocks of at most ``block_terms`` distinct terms and one item, whose terms, weights and
statistics are broadcast; every row is indexed on the terms of the block. Statistics (documents, terms, document frequencies) cover all rows.

Edge cases: null, empty or wordless text has no terms, isn't counted and isn't found; an item without terms that occur has no rows; repeated rows
are documents of their own; rows without an id are found as null, after all others of their score; repeated items are ranked each; ids
are whole numbers; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_WORDS, Scratch, as_bytes, enter
from .decontaminate import words

TOP = 20
BLOCK_TERMS = 200_000
SEGMENT_DOCS = 4096
#: Cells of (item, document) that are summed at once.
CELLS = 4_000_000
#: Shares of the largest possible score of a posting that the postings of each tier but the last reach.
CUTS = (1 / 6, 1 / 16)
_LAST = np.iinfo(np.int64).max
_ints, _longs = pa.list_(pa.int32()), pa.list_(pa.int64())


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind.value_type))


def _row(array: pa.Array, i: int) -> np.ndarray:
    return array[i].values.to_numpy()


def segments(docs: DataFrame, asked, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents on the asked terms (a broadcast of (name, terms)): a row for each bounded run of documents that have any term at all.

    ids, n (terms of each, with repeats), ends (of each document's part of the next two), terms (numbers of asked terms), tf.
    """
    held: dict[str, dict[bytes, int]] = {}

    def rows(ids: list, counts: list[int], found: list[np.ndarray], n_asked: int) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
        key, tf = np.unique(doc * n_asked + np.concatenate(found), return_counts=True)
        ends = np.searchsorted(key, np.arange(1, len(found) + 1) * n_asked)
        id_list = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))
        return pa.RecordBatch.from_arrays([id_list, _list(np.array(counts), _longs), _list(ends, _ints), _list(key % n_asked, _ints), _list(tf, _ints)], names=["ids", "n", "ends", "terms", "tf"])

    def run(batches):
        name, terms = asked.value
        enter("tiered_search", held.clear)
        if name not in held:
            held.clear()
            held[name] = {t: i for i, t in enumerate(terms)}
        number, n_asked = held[name].get, max(1, len(terms))
        ids: list = []
        counts: list[int] = []
        found: list[np.ndarray] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("_id").to_pylist(), as_bytes(b.column("_text"))):
                ws = words(text)
                if not ws:
                    continue
                at = np.fromiter((number(w, -1) for w in ws), np.int64, len(ws))
                ids.append(doc_id)
                counts.append(len(ws))
                found.append(at[at >= 0])
                size += len(ws)
                if size >= CHUNK_WORDS or len(ids) == SEGMENT_DOCS:
                    yield rows(ids, counts, found, n_asked)
                    ids, counts, found, size = [], [], [], 0
        if ids:
            yield rows(ids, counts, found, n_asked)

    given = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return given.mapInArrow(run, "ids array<long>, n array<long>, ends array<int>, terms array<int>, tf array<int>")


def statistics(found: DataFrame, n_asked: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and the document frequency of each asked term, of segments()."""

    def run(batches):
        df, n_docs, n_terms = np.zeros(n_asked, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=n_asked)
            n_docs += len(b.column("n").flatten())
            n_terms += int(b.column("n").flatten().to_numpy().sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, (-1, -2)), pa.int32()), pa.array(np.append(df[some], (n_docs, n_terms)), pa.int64())], names=["term", "n"])

    got = found.select("terms", "n").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by = dict(zip(got["term"].to_pylist(), got["n"].to_pylist()))
    df = np.zeros(n_asked, np.int64)
    for t, n in by.items():
        if t >= 0:
            df[t] = n
    return by.get(-1, 0), by.get(-2, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """Weight of each term; 0 for a term that no document has."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def tiers(n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, cuts: tuple[float, ...] = CUTS) -> tuple[list, list]:
    """Of a segment: (terms, ends, docs, impacts) of each tier, and (terms, bounds) below each tier but the last."""
    doc = np.repeat(np.arange(len(n)), np.diff(ends, prepend=0))
    m = 75 + 25 * n.astype(np.int64) * n_docs // n_terms
    tf = tf.astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    gives = impact * weight[terms]
    top = math.floor(1000 * math.log(2 * n_docs + 2)) * 1_000_000
    tier = np.full(len(terms), len(cuts))
    for j in reversed(range(len(cuts))):
        tier[gives >= cuts[j] * top] = j
    tier[gives == 0] = -1
    parts, rests = [], []
    for j in range(len(cuts) + 1):
        at = np.flatnonzero(tier == j)
        at = at[np.lexsort((doc[at], terms[at]))]
        own, n_own = np.unique(terms[at], return_counts=True)
        parts.append((own, np.cumsum(n_own), doc[at], impact[at]))
        if j < len(cuts):
            below = np.flatnonzero(tier > j)
            below = below[np.lexsort((-impact[below], terms[below]))]
            own, first = np.unique(terms[below], return_index=True)
            rests.append((own, impact[below][first]))
    return parts, rests


_TIER = "struct<terms:array<int>,ends:array<int>,docs:array<int>,impacts:array<int>>"
_REST = "struct<terms:array<int>,bounds:array<int>>"


def index(found: DataFrame, weight, n_docs: int, n_terms: int, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """segments() as tiers: ids, tier_0, tier_1 ..., rest_0 ... (weight: a broadcast)."""

    def run(batches):
        enter("tiered_search")
        for b in batches:
            for i in range(b.num_rows):
                parts, rests = tiers(*(_row(b.column(c), i) for c in ("n", "ends", "terms", "tf")), weight.value, n_docs, n_terms, cuts)
                cols = [b.column("ids").slice(i, 1)]
                cols += [pa.StructArray.from_arrays([_list(x, _ints) for x in p], ["terms", "ends", "docs", "impacts"]) for p in parts]
                cols += [pa.StructArray.from_arrays([_list(x, _ints) for x in r], ["terms", "bounds"]) for r in rests]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", *(f"tier_{j}" for j in range(len(parts))), *(f"rest_{j}" for j in range(len(rests)))])

    schema = ["ids array<long>", *(f"tier_{j} {_TIER}" for j in range(len(cuts) + 1)), *(f"rest_{j} {_REST}" for j in range(len(cuts)))]
    return found.mapInArrow(run, ", ".join(schema))


class Items:
    """The items of a block as (item, term, weight) pairs, a weight being that of the term times its repeats in the item."""

    def __init__(self, lists: list[list[int]], weight: np.ndarray):
        pairs = [np.unique(np.array(x, np.int64), return_counts=True) for x in lists]
        self.n = len(lists)
        self.item = np.repeat(np.arange(self.n), [len(t) for t, _ in pairs])
        self.term = np.concatenate([np.empty(0, np.int64), *(t for t, _ in pairs)])
        self.weight = weight[self.term] * np.concatenate([np.empty(0, np.int64), *(c for _, c in pairs)])


def sums(where: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole-number sums of values by place."""
    if not len(values) or float(np.abs(values).astype(np.float64).sum()) < 2**53:
        return np.bincount(where, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, where, values)
    return out


def postings(tier: tuple, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, doc, impact): the postings of each term asked for."""
    own, ends, doc, impact = tier
    if not len(own):
        return (np.empty(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(own, term), len(own) - 1)
    n = np.where(own[at] == term, np.diff(ends, prepend=0)[at], 0)
    place = np.arange(n.sum()) + np.repeat(ends[at] - np.cumsum(n), n)
    return np.repeat(np.arange(len(term)), n), doc[place], impact[place].astype(np.int64)


def segment_scores(items: Items, parts: list[tuple], rests: list[tuple], n_docs: int, must: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(item, docs, scores, tiers read) of a segment, for items of which a document may reach what it must; scores are exact if all tiers are given."""
    width = max(1, CELLS // max(1, n_docs))
    for lo in range(0, items.n, width):
        hi = min(items.n, lo + width)
        pairs = np.flatnonzero((items.item >= lo) & (items.item < hi) & (items.weight > 0))
        score, seen, alive, depth = np.zeros((hi - lo) * n_docs, np.int64), [], np.ones(hi - lo, bool), 0
        for j, tier in enumerate(parts):
            pairs = pairs[alive[items.item[pairs] - lo]]
            if not len(pairs):
                break
            p, doc, impact = postings(tier, items.term[pairs])
            p, depth = pairs[p], j + 1
            cell = (items.item[p] - lo) * n_docs + doc
            score += sums(cell, items.weight[p] * impact, len(score))
            if j >= len(rests) or j + 1 == len(parts):
                reach = score
            else:
                own, bound = rests[j]
                limit = np.zeros(len(items.term), np.int64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, items.term[pairs]), len(own) - 1)
                    limit[pairs] = np.where(own[at] == items.term[pairs], bound[at], 0) * items.weight[pairs]
                seen.append((p, cell))
                reach = score + np.repeat(sums(items.item[pairs] - lo, limit[pairs], hi - lo), n_docs)
                for q, at in seen:
                    reach = reach - sums(at, limit[q], len(score))
            alive &= (reach.reshape(hi - lo, n_docs) >= np.maximum(must[lo:hi], 1)[:, None]).any(1)
        for i in np.flatnonzero(alive).tolist():
            own = score[i * n_docs : (i + 1) * n_docs]
            docs = np.flatnonzero(own >= max(1, must[lo + i]))
            if len(docs):
                yield lo + i, docs, own[docs], depth


def search(found: DataFrame, items, n_tiers: int, top: int = TOP, must: np.ndarray | None = None) -> DataFrame:
    """(item, doc_id, score): the best rows of each item, `top` of each task at most, by the first n_tiers of index() (items: a broadcast).

    With all tiers, scores are exact and documents below `must` of an item are left out.
    """
    names = [f"tier_{j}" for j in range(n_tiers)]
    bounds = [c for c in found.columns if c.startswith("rest_")] if must is not None else []

    def run(batches):
        enter("tiered_search")
        mine: Items = items.value
        least = np.zeros(mine.n, np.int64) if must is None else must.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values
                key = ids.fill_null(_LAST).to_numpy()
                parts = [tuple(_row(b.column(c).field(k), i) for k in range(4)) for c in names]
                rests = [tuple(_row(b.column(c).field(k), i) for k in range(2)) for c in bounds]
                for item, docs, score, _ in segment_scores(mine, parts, rests, len(key), least):
                    had = best.get(item, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    s, d = np.concatenate((had[0], score)), np.concatenate((had[1], key[docs]))
                    order = np.lexsort((d, -s))[:top]
                    best[item] = s[order], d[order]
                    if len(order) == top:
                        least[item] = max(least[item], s[order[-1]])
        for item, (s, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), item), pa.int32()), pa.array(d, pa.int64(), mask=d == _LAST), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])

    rows = found.select("ids", *names, *bounds).mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def blocks(queries: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple]]:
    """(id, terms) of the items, in blocks of bounded size, streamed to the driver one partition at a time."""
    block, seen = [], set()
    for r in queries.select(F.col(id_col), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        ws = words(r[1].encode())
        if ws:
            block.append((r[0], ws))
            seen.update(ws)
        if len(seen) >= block_terms:
            yield block
            block, seen = [], set()
    if block:
        yield block


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """(item, rank, doc, score): the `top` highest-scoring documents of each item with a score above 0, equal scores by document."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    kind = queries.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"_item {kind}, rank int, doc_id long, score long")
    for block in blocks(queries, item_col, item_text, block_terms):
        scratch = Scratch(spark, "tiered")
        terms = sorted({w for _, ws in block for w in ws})
        number = {t: i for i, t in enumerate(terms)}
        found = scratch.keep(segments(docs, share((uuid.uuid4().hex, terms)), id_col, text_col))
        n_docs, n_terms, df = statistics(found, len(terms))
        weight = weights(n_docs, df)
        tiered = scratch.keep(index(found, share(weight), n_docs, max(1, n_terms), cuts))
        scratch.drop(found)
        items = share(Items([[number[w] for w in ws] for _, ws in block], weight))
        must = np.zeros(len(block), np.int64)
        first = search(tiered, items, 1, top).where(F.col("rank") == top).select("item", "score").toArrow()
        must[first["item"].to_numpy()] = first["score"].to_numpy()
        best = search(tiered, items, len(cuts) + 1, top, must)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item int, _item {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("_item", "rank", "doc_id", "score"))
    return out.select(F.col("_item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
