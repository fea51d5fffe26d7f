"""Exact set-similarity join under the Jaccard metric: links, their number, and connected components.

A document is the set of its distinct k-word shingles; two documents link when
``den * |x & y| >= num * |x | y|``, i.e. when their Jaccard distance is at most eps = 1 - num / den.

Equal sets are one point of the metric space, weighted by its copies. Links between points come from pivots:

* Some points of a cell become pivots. Each point belongs to the Voronoi cell of its nearest pivot and is replicated, as
  a window copy, to every cell i with d(x, p_i) <= d(x, p_home) + 2 eps; by the triangle inequality the cell where a
  point is at home holds all that it links with. Cells divide again while that shrinks them; a point's links are
  counted in its last home cell, exactly, and nowhere else.
* Cells of at most ``max_docs`` points and ``max_items`` shingles divide inside one task. Larger ones divide as tables;
  what pivots can't shrink is compared in pairs of bounded blocks, each a cell of its own.

In natural-language data nearly all pairs are at distance 1 from each other and from any pivot, so pivots alone would
replicate everything everywhere. Two exact prunings come first; they only say which points may share a cell:

* Size regions: linked sizes differ by at most the factor num / den. Level g holds sizes from starts[g] on; what is
  small enough to link with level g also enters it from the level above.
* Class regions: the universe is hashed into K(g) classes. A linked pair differs in at most D elements, so with more
  than D classes some coincide; a set signs its first D + 1 classes that hold enough elements, which is enough for one of
  them to coincide. Points with a common signature are in one region (star links to the smallest, never pairs).

A region holds whole components, so a region within the limits is finished by its task. Passages that many documents
quote fill classes of their own and chain documents into large regions that hold hardly a link, so larger regions come
apart once more, exactly: elements that one set alone holds stand first, those that many hold last, and in any such order
linked sets have one of their first n - ceil(num n / den) + 1 elements in common.

Edge cases: null or blank text is an empty set, which links with nothing (component_id is its own doc_id, n_links 0).
Repeated rows give repeated rows, which link with each other; an id with several texts counts each. A null doc_id takes
the smallest doc_id of its component, null if that has none. Columns other than the id and the text are ignored,
whatever their names. Shingles are compared by 64-bit hashes, sets by 128-bit fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import CHUNK_WORDS, Bits, Scratch, as_bytes, bound_batches, components, enter, groups, mix, shingle_set

SEEDS = 4


class Levels:
    """Size regions: level g holds sizes in [starts[g], starts[g + 1]); K(g) classes serve pairs of g and of g with g + 1.

    From the size `rich` on, only classes of two or more elements sign; there are few enough classes for that.
    """

    def __init__(self, num: int, den: int, longest: int = 1 << 26, span: float = 1.8, rich: int = 60):
        self.num, self.den = num, den
        span, starts = max(span, 1.01 * den / num), [1]
        while starts[-1] <= longest:
            starts.append(max(starts[-1] + 1, int(starts[-1] * span) + 1))
        self.starts = np.array(starts, np.int64)
        self.top = self.starts[1:] - 1  # largest size of each level
        share = (den - num) * (1 + den / num) / (den + num)  # differences for an element of the smaller set, at most
        # elements a class, such that classes of `least` elements or more outnumber the differences
        self.least = np.where(self.starts[:-1] >= rich, 2, 1)
        fill = {}
        for least in (1, 2):
            x = np.arange(1.0, 12.0, 0.05)
            strong = (1 - np.exp(-x) * (1 + (x if least == 2 else 0))) / x
            fill[least] = float(x[strong >= 1.03 * share].max(initial=1.0))
        self.classes = np.ceil(self.top / np.where(self.least == 2, fill[2], fill[1])).astype(np.int64) + 1
        self.classes[self.starts[:-1] < rich] += 2
        self.classes[0] = 1 if self.top[0] * den // num == self.top[0] else self.classes[0]

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def differ(self, n: np.ndarray, below: int) -> np.ndarray:
        """Most elements in which a set of n differs from what it links with in its level, or in the level below."""
        other = self.top[np.maximum(self.of(n) - 1, 0)] if below else n * self.den // self.num
        return (self.den - self.num) * (n + other) // (self.den + self.num)

    def enters(self, n: np.ndarray, below: int) -> np.ndarray:
        """Whether a set of n takes part in its level, or in the one below."""
        level = self.of(n) - below
        return (n > 0) & (level >= 0) & ((below == 0) | (n <= self.top[np.maximum(level, 0)] * self.den // self.num))


def class_signatures(sets: list[np.ndarray], levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, 64-bit signature) rows: what each set has in its first classes, for its level and the one below.

    A set signs its first D + 1 classes of `least` elements or more. A linked pair differs in at most D, so up to the
    smaller of the two last classes one such class coincides, and both sign it. A set with fewer such classes signs them
    all and is hashed again with another seed; after the last seed it gets one common signature, so no link is lost.
    """
    n = np.array([len(s) for s in sets], np.int64)
    out_i, out_s = [], []
    for below in (0, 1):
        level, differ = np.maximum(levels.of(n) - below, 0), levels.differ(n, below)
        todo = np.flatnonzero(levels.enters(n, below))
        for seed in range(SEEDS):
            if not len(todo):
                break
            k = levels.classes[level[todo]]
            start = np.concatenate(([0], np.cumsum(k)))
            flat = np.concatenate([sets[i] for i in todo])
            owner = np.repeat(np.arange(len(todo)), n[todo])
            salt = np.uint64(0xD6E8FEB86659FD93 * (seed + 1) % 2**64)
            with np.errstate(over="ignore"):
                h = mix(flat ^ salt)
                at = start[owner] + ((h >> np.uint64(32)).astype(np.int64) * k[owner] >> 32)
                v = mix(h + np.uint64(0x2545F4914F6CDD1D))
                low = np.bincount(at, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), start[-1]).astype(np.uint64)
                high = np.bincount(at, (v >> np.uint64(32)).astype(np.float64), start[-1]).astype(np.uint64)
                strong = np.bincount(at, minlength=start[-1]) >= np.repeat(levels.least[level[todo]], k)
                doc = np.repeat(np.arange(len(todo)), k)
                total = np.cumsum(strong)
                nth = total - (total[start[:-1]] - strong[start[:-1]])[doc]
                number = np.arange(start[-1]) - start[doc]
                tag = ((level[todo][doc].astype(np.uint64) << np.uint64(40)) + (np.uint64(seed) << np.uint64(32))) + number.astype(np.uint64)
                sig = mix(mix(low + (high << np.uint64(32))) ^ mix(tag + np.uint64(0x9E3779B97F4A7C15)))
            signed = strong & (nth <= differ[todo][doc] + 1)
            out_i.append(todo[doc[signed]])
            out_s.append(sig[signed])
            todo = todo[np.bincount(doc[strong], minlength=len(todo)) <= differ[todo]]
        out_i.append(todo)
        out_s.append(mix(level[todo].astype(np.uint64) + np.uint64(77)))
    return np.concatenate(out_i), np.concatenate(out_s)


def _sets(ids: list, texts: list[bytes | None], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of bounded chunks of texts."""
    part, sets, held = [], [], 0
    for i, t in zip(ids, texts):
        part.append(i)
        sets.append(shingle_set((t or b"").lower().split(), k))
        held += len(sets[-1])
        if held > CHUNK_WORDS:
            yield part, sets
            part, sets, held = [], [], 0
    if part:
        yield part, sets


def _print(x: np.ndarray) -> tuple[int | None, int | None]:
    """128-bit fingerprint of a set in two signed halves; none for the empty set."""
    if not len(x):
        return None, None
    f = xxhash.xxh3_128_intdigest(x.tobytes())
    return (f & (2**64 - 1)) - 2**63, (f >> 64) - 2**63


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2): size and fingerprint of each document's set; null for an empty one."""

    def run(batches):
        enter("jaccard")
        for b in batches:
            for ids, sets in _sets(b.column(0).to_pylist(), as_bytes(b.column(1)), k):
                f = [_print(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in f], pa.int64()), pa.array([x[1] for x in f], pa.int64())],
                    names=["doc_id", "n_shingles", "f1", "f2"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long")


def signatures(docs: DataFrame, firsts: Bits, k: int, num: int, den: int) -> DataFrame:
    """(sig, node): signatures of the sets of documents that may be the first of their set; node is the id, or a hash for none."""

    def run(batches):
        levels = Levels(num, den)
        for b in batches:
            keep = pa.array(firsts.passing(b.column(0).to_pylist()))
            b = b.take(keep)
            for ids, sets in _sets(b.column(0).to_pylist(), as_bytes(b.column(1)), k):
                node = np.array([(_print(s)[0] or 0) if x is None else x for x, s in zip(ids, sets)], np.int64)
                i, s = class_signatures(sets, levels)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(node[i])], names=["sig", "node"])

    return docs.mapInArrow(run, "sig long, node long")


def stars(sigs: DataFrame) -> DataFrame:
    """(a, b): each node with the smallest node of its signature. Rows arrive sorted and are never gathered."""

    def run(batches):
        last, first = None, None
        for b in batches:
            sig, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.concatenate(([sig[0] != last], sig[1:] != sig[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            low = np.where(at >= 0, node[at], first if first is not None else 0)
            last, first = sig[-1], low[-1]
            keep = low != node
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(low[keep])], names=["a", "b"])

    return sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "a long, b long")


def _first(x: np.ndarray, tiers: list[Bits], num: int, den: int) -> np.ndarray:
    """Of a set's first elements, by tier and then hash, of which linked sets have one in common, those that another set may hold."""
    rank = np.zeros(len(x), np.uint8)
    for i, t in enumerate(tiers):  # what is in a tier is in those before it
        at = np.flatnonzero(rank == i)
        rank[at[t.passing(x[at].view(np.int64))]] += 1
    order = np.lexsort((x, rank))[: len(x) - -(-num * len(x) // den) + 1]
    return x[order[rank[order] > 0]]


def refine(scratch: Scratch, members: DataFrame, num: int, den: int, often: tuple[int, ...] = (2, 16, 256)) -> DataFrame:
    """members (cell, f1, items, ...) of large regions in finer cells, without the sets that link with no other.

    often: an element's tier is the number of these that its sets are at least as many as.
    """

    def elements(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                x = np.frombuffer(b"".join(b.column(0).slice(lo, 256).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x)], names=["x"])

    held = members.select("items").mapInArrow(elements, "x long").groupBy("x").agg(F.count("*").alias("n"))
    held = scratch.keep(held.where(F.col("n") >= often[0]))
    tiers = [Bits(held.where(F.col("n") >= n).select("x")) for n in often]

    def sign(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sigs = [_first(np.frombuffer(x, np.uint64), tiers, num, den) for x in part.column(1).to_pylist()]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in sigs])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(node)], names=["sig", "node"])

    signed = members.select("f1", "items").mapInArrow(sign, "sig long, node long")
    found = components(scratch, scratch.keep(stars(signed)), drop_input=True).select(F.col("id").alias("f1"), "root")
    linked = Bits(found.select("f1"))
    at = members.columns.index("f1")

    def some(batches):
        for b in batches:
            yield b.take(pa.array(linked.passing(b.column(at).to_numpy())))

    out = scratch.keep(members.mapInArrow(some, members.schema).join(found, "f1").withColumn("cell", F.concat_ws("-", "cell", "root")).select(*members.columns))
    scratch.drop(held)
    scratch.drop(members)
    return out


def search(sets: list[np.ndarray], labels: list, num: int, den: int) -> np.ndarray:
    """Component number of each set, exactly. Equal labels (None: unknown) are connected from the start.

    Breadth first: a document is compared with those not reached yet, through an inverted index of these, which is
    rebuilt as they get fewer; sizes outside the window of the empty-set pivot are skipped.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    comp = np.full(m, -1)
    same: dict = {}
    for i, x in enumerate(labels):
        if x is not None:
            same.setdefault(x, []).append(i)
    active = np.ones(m, bool)
    left, built = m, None
    number = 0
    for first in range(m):
        if comp[first] >= 0:
            continue
        stack, comp[first] = [first], number
        active[first] = False
        left -= 1
        while stack:
            q = stack.pop()
            if labels[q] is not None:
                more = [i for i in same.pop(labels[q], ()) if comp[i] < 0]
                if more:
                    comp[more], active[more] = number, False
                    left -= len(more)
                    stack += more
            if not left:
                comp[comp < 0] = number
                break
            if built is None or left * 2 < built:
                ids = np.flatnonzero(active)
                flat = np.concatenate([sets[i] for i in ids])
                own = np.repeat(ids, size[ids])
                order = np.argsort(flat, kind="stable")
                flat, own, built = flat[order], own[order], left
            lo, hi = np.searchsorted(flat, sets[q], "left"), np.searchsorted(flat, sets[q], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            hits, both = np.unique(own[at], return_counts=True)
            ok = active[hits] & (den * both >= num * (size[q] + size[hits] - both))
            new = hits[ok]
            if len(new):
                comp[new], active[new] = number, False
                left -= len(new)
                stack += new.tolist()
        number += 1
    return comp


def _solve(num: int, den: int):
    """Links (a, b) that connect the documents of each cell; cells arrive one after the other, sorted."""

    def run(batches):
        for t in groups(batches, "cell"):
            ids = t.column("doc_id").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            comp = search(sets, t.column("label").to_pylist(), num, den)
            first: dict[int, int] = {}
            for i, c in zip(ids, comp.tolist()):
                first[c] = min(i, first.get(c, i))
            out = [(i, first[c]) for i, c in zip(ids, comp.tolist()) if i != first[c]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _assign(num: int, den: int):
    """Rows (cell, doc_id, pivots) of the documents' distances to their region's pivots.

    near: indices of pivots within eps; home: nearest; window: cells that its links may reach.
    """

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"cell": [], "doc_id": [], "home": [], "near": [], "window": []}
            index: dict = {}
            for cell, i, items, pivots in zip(*(b.column(c).to_pylist() for c in ("cell", "doc_id", "items", "pivots"))):
                if cell not in index:
                    p = [np.frombuffer(x["items"], np.uint64) for x in sorted(pivots, key=lambda x: x["doc_id"])]
                    flat = np.concatenate(p)
                    order = np.argsort(flat, kind="stable")
                    index[cell] = flat[order], np.repeat(np.arange(len(p)), [len(x) for x in p])[order], np.array([len(x) for x in p])
                flat, own, size = index[cell]
                x = np.frombuffer(items, np.uint64)
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(own[at], minlength=len(size))
                union = len(x) + size - both
                d = 1 - both / union
                home = int(np.argmin(d))
                out["cell"].append(cell)
                out["doc_id"].append(i)
                out["home"].append(home)
                out["near"].append(np.flatnonzero(den * both >= num * union).tolist())
                out["window"].append(np.flatnonzero(d <= d[home] + 2 * (1 - num / den) + 1e-9).tolist())
            kind = {"cell": pa.string(), "doc_id": pa.int64(), "home": pa.int32(), "near": pa.list_(pa.int32()), "window": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kind[k]) for k, v in out.items()], names=list(out))

    return run


def _pivot_groups(key, pdf):
    """Connected pivots of a cell, through documents and through labels they share."""
    import pandas as pd

    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in zip(pdf["x"], pdf["y"]):
        parent[find(a)] = find(b)
    rows = [(key[0], int(x[1:]), find(x)) for x in list(parent) if x[0] == "p"]
    name: dict = {}
    for _, p, g in sorted(rows):
        name.setdefault(g, p)
    return pd.DataFrame([(c, p, f"{c}#{name[g]}") for c, p, g in rows], columns=["cell", "pivot", "grp"])


def _pivots(rest: DataFrame, level: int, pivots: int) -> DataFrame:
    """(cell, doc_id) of at most `pivots` points of each cell: the one with the least hash of each part of it."""
    h = F.xxhash64("doc_id", F.lit(level))
    return rest.groupBy("cell", F.pmod(h, F.lit(pivots)).alias("part")).agg(F.min_by("doc_id", F.struct(h, "doc_id")).alias("doc_id")).select("cell", "doc_id")


def divide(scratch: Scratch, members: DataFrame, num: int, den: int, max_docs: int, max_items: int, pivots: int = 32, depth: int = 6) -> DataFrame:
    """Links (a, b) whose components are those of all links within each cell of members (cell, doc_id, label, items)."""
    links = None
    add = lambda x: x if links is None else links.unionByName(x)
    solve = _solve(num, den)
    for level in range(depth + 1):
        size = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.length("items") / 8).alias("items_n"))
        size = scratch.keep(size)
        big = size.where((F.col("n") > max_docs) | (F.col("items_n") > max_items))
        small = members.join(big.select("cell"), "cell", "left_anti")
        found = small.repartition("cell").sortWithinPartitions("cell", "doc_id").select("cell", "doc_id", "label", "items").mapInArrow(solve, "a long, b long")
        links = add(scratch.keep(found))
        if big.isEmpty():
            scratch.drop(members)
            return links
        rest = scratch.keep(members.join(big.select("cell", "n"), "cell", "left_semi"))
        if level == depth:
            return add(scratch.keep(blocks(rest, num, den, max_docs, max_items)))
        chosen = _pivots(rest, level, pivots)
        own = rest.select("cell", "doc_id", "items", "label").join(chosen.select("cell", "doc_id"), ["cell", "doc_id"], "left_semi").dropDuplicates(["cell", "doc_id"])
        own = scratch.keep(own)
        # each cell's pivots (at most `pivots` sets) meet its documents in `spread` tasks
        spread = 32
        lists = own.groupBy("cell").agg(F.collect_list(F.struct("doc_id", "items")).alias("pivots")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        dealt = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")).join(lists, ["cell", "salt"])
        where = scratch.keep(dealt.select("cell", "doc_id", "items", "pivots").mapInArrow(_assign(num, den), "cell string, doc_id long, home int, near array<int>, window array<int>"))
        # at most `pivots` rows a cell
        names = own.groupBy("cell").agg(F.array_sort(F.collect_list("doc_id")).alias("p")).select("cell", F.posexplode("p").alias("pivot", "pid"))
        names = scratch.keep(names)
        near = where.select("cell", "doc_id", F.explode("near").alias("pivot"))
        links = add(scratch.keep(near.join(names, ["cell", "pivot"]).select(F.col("doc_id").alias("a"), F.col("pid").alias("b")).where("a <> b")))
        known = rest.select("cell", "doc_id", "label")
        p = lambda c: F.concat(F.lit("p"), F.col(c))
        ties = where.select("cell", F.col("near")[0].alias("f"), F.explode("near").alias("g")).select("cell", p("f").alias("x"), p("g").alias("y"))
        ties = ties.unionByName(near.join(known.where("label is not null"), ["cell", "doc_id"]).select("cell", p("pivot").alias("x"), F.concat(F.lit("l"), "label").alias("y")))
        ties = ties.unionByName(names.select("cell", p("pivot").alias("x"), p("pivot").alias("y"))).distinct()
        grp = scratch.keep(ties.groupBy("cell").applyInPandas(_pivot_groups, "cell string, pivot int, grp string"))
        g0 = grp.select("cell", F.col("pivot").alias("p0"), F.col("grp").alias("g0"))
        own_label = where.withColumn("p0", F.get("near", F.lit(0))).join(g0, ["cell", "p0"], "left").join(known, ["cell", "doc_id"])
        own_label = own_label.select("cell", "doc_id", "home", "window", F.coalesce("g0", "label").alias("label"))
        cells = own_label.select("cell", "doc_id", "home", "label", F.explode("window").alias("pivot")).join(grp, ["cell", "pivot"])
        cells = cells.where((F.col("pivot") == F.col("home")) | F.col("label").isNull() | (F.col("label") != F.col("grp")))
        placed = cells.select("cell", "doc_id", "label", F.concat_ws("/", "cell", "pivot").alias("next"))
        # a cell whose documents are connected already has nothing left to find
        placed = scratch.keep(placed)
        if placed.count() > 2 * rest.count():
            return add(scratch.keep(blocks(rest, num, den, max_docs, max_items)))
        live = placed.groupBy("next").agg(F.count_if(F.col("label").isNull()).alias("open"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("open > 0 or l0 <> l1")
        whole, parted = members, rest
        members = scratch.keep(
            placed.join(live.select("next"), "next", "left_semi")
            .join(rest.select("cell", "doc_id", "items").dropDuplicates(["cell", "doc_id"]), ["cell", "doc_id"])
            .select(F.col("next").alias("cell"), "doc_id", "label", "items")
        )
        scratch.drop(whole)
        scratch.drop(parted)
    return links


def blocks(members: DataFrame, num: int, den: int, max_docs: int, max_items: int) -> DataFrame:
    """Exact search of cells that pivots can't shrink: each pair of bounded blocks of a cell is one cell of its own."""
    total = members.groupBy("cell").agg(F.greatest(F.ceil(2 * F.count("*") / max_docs), F.ceil(2 * F.sum(F.length("items") / 8) / max_items)).cast("int").alias("b"))
    dealt = members.join(total, "cell").withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit("b")), F.col("b")).cast("int"))
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).where("b = 1 or i <> j")
    pairs = pairs.withColumn("cell", F.concat_ws("|", "cell", F.least("i", "j"), F.greatest("i", "j")))
    return pairs.repartition("cell").sortWithinPartitions("cell", "doc_id").select("cell", "doc_id", "label", "items").mapInArrow(_solve(num, den), "a long, b long")


def intersections(sets: list[np.ndarray], own: np.ndarray, often: int = 16, width: int = 1024) -> np.ndarray:
    """Sizes of the intersections of the sets at `own` (rows) with all sets: frequent elements by matrix products, the others by pairs of owners."""
    m = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    _, col, held = np.unique(flat, return_inverse=True, return_counts=True)
    at = np.full(m, -1)
    at[own] = np.arange(len(own))
    both = np.zeros((len(own), m), np.int32)
    few = (held[col] > 1) & (held[col] <= often)
    order = np.argsort(col[few], kind="stable")
    c, r = col[few][order], row[few][order]
    for step in range(1, often):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        a, b = r[same], r[same + step]
        a, b = at[np.concatenate((a, b))], np.concatenate((b, a))
        both += np.bincount((a * m + b)[a >= 0], minlength=both.size).reshape(both.shape).astype(np.int32)
    many = held > often
    number = np.cumsum(many) - 1
    c, r = number[col[many[col]]], row[many[col]]
    order = np.argsort(c, kind="stable")
    c, r = c[order], r[order]
    for lo in range(0, int(many.sum()), width):
        part = slice(*np.searchsorted(c, (lo, lo + width)))
        x = np.zeros((m, width), np.float32)
        x[r[part], c[part] - lo] = 1
        both += (x[own] @ x.T).astype(np.int32)
    return both


def distances(sets: list[np.ndarray], pivots: np.ndarray) -> np.ndarray:
    """Intersection sizes of all sets (rows) with those at `pivots` (columns)."""
    p = len(pivots)
    flat = np.concatenate([sets[i] for i in pivots])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], np.repeat(np.arange(p), [len(sets[i]) for i in pivots])[order]
    x, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.bincount(np.repeat(row, n) * p + own[at], minlength=len(sets) * p).reshape(len(sets), p)


def voronoi_links(sets: list[np.ndarray], own: np.ndarray, num: int, den: int, counter: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All links (x, y) of the sets at `own` with any set, each once; pivots divide the cell until that shrinks it no more."""
    out_x, out_y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    size = np.array([len(s) for s in sets], np.int64)
    cells = [(np.asarray(own, np.int64), np.setdiff1d(np.arange(len(sets)), own))]
    while cells:
        home, copies = cells.pop()
        if not len(home) or len(home) + len(copies) < 2:
            continue
        all_ = np.concatenate((home, copies))
        m = len(all_)
        if m > 2:
            step = max(2, math.isqrt(m))
            pivots = np.arange(step) * m // step
            both = distances([sets[i] for i in all_], pivots)
            d = 1 - both / (size[all_][:, None] + size[all_][pivots][None] - both)
            nearest = d.argmin(1)
            window = d <= d[np.arange(m), nearest][:, None] + 2 * (1 - num / den) + 1e-9
            held = window.sum(0)
            if held.max() < m and held.sum() <= 3 * m:
                if counter is not None:
                    counter["placed"] = counter.get("placed", 0) + len(home)
                resident = np.arange(m) < len(home)
                for i in range(step):
                    at = nearest == i
                    cells.append((all_[at & resident], all_[window[:, i] & ~(at & resident)]))
                continue
        part = [sets[i] for i in all_]
        both = intersections(part, np.arange(len(home))).astype(np.int64)
        ok = den * both >= num * (size[home][:, None] + size[all_] - both)
        ok[np.arange(len(home)), np.arange(len(home))] = False
        x, y = np.nonzero(ok)
        out_x.append(home[x])
        out_y.append(all_[y])
    return np.concatenate(out_x), np.concatenate(out_y)


def connected(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component of each of m nodes under links x-y: the smallest node in it."""
    low = np.arange(m)
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == before).all():
            return low


def _finish(k: int, num: int, den: int):
    """(f1, f2, component, links, chosen) of the linked sets of whole regions that arrive one after the other, as texts.

    chosen: the member with the smallest id, of equal ones with the smallest f1.
    """

    def run(batches):
        for t in groups(batches, "cell"):
            f1, node = t.column("f1").to_pylist(), t.column("rep").to_pylist()
            # rows of one set stand side by side
            first = [i for i in range(len(f1)) if i == 0 or f1[i] != f1[i - 1]]
            if len(first) < 2:
                continue
            t, node = t.take(pa.array(first)), [node[i] for i in first]
            sets = [shingle_set(x.lower().split(), k) for x in t.column("text").cast(pa.binary()).to_pylist()]
            x, y = voronoi_links(sets, np.arange(len(sets)), num, den)
            if not len(x):
                continue
            low = connected(len(sets), x, y)
            best: dict[int, tuple] = {}
            for i, c in enumerate(low.tolist()):
                own_place = (node[i] is None, node[i] or 0, i)
                best[c] = min(best.get(c, own_place), own_place)
            links = np.bincount(x, t.column("n_copies").to_numpy()[y], len(sets)).astype(np.int64)
            some = np.flatnonzero(links)
            top = [best[c] for c in low[some].tolist()]
            own, chosen = [None if z[0] else z[1] for z in top], [z[2] == i for z, i in zip(top, some.tolist())]
            take = lambda c: t.column(c).combine_chunks().take(pa.array(some))
            yield pa.RecordBatch.from_arrays([take("f1"), take("f2"), pa.array(own, pa.int64()), pa.array(links[some]), pa.array(chosen, pa.bool_())], names=["f1", "f2", "component", "links", "chosen"])

    return run


def _count(num: int, den: int):
    """(f, links, low): rows that the own sets of each cell link with there, and the smallest member each member links up with.

    Sets with a part meet those of other parts only.
    """

    def run(batches):
        for t in groups(batches, "cell"):
            own = np.flatnonzero(t.column("own").to_numpy())
            if t.num_rows < 2 or not len(own):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            part, name = t.column("part").to_numpy(), t.column("doc_id").to_numpy()
            x, y = voronoi_links(sets, own, num, den)
            ok = (part[x] < 0) | (part[x] != part[y])
            x, y = x[ok], y[ok]
            links = np.bincount(x, t.column("n_copies").to_numpy()[y], len(sets)).astype(np.int64)
            low = connected(len(sets), x, y)
            some = np.flatnonzero((links > 0) | (low < np.arange(len(sets))))
            yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(links[some]), pa.array(name[low[some]])], names=["f", "links", "low"])

    return run


def count_links(scratch: Scratch, members: DataFrame, num: int, den: int, max_docs: int, max_items: int, pivots: int = 32, depth: int = 6) -> DataFrame:
    """(f, links, low) parts for members (cell, f1, n_copies, items): links of each set, to be summed, and what connects it."""
    fields = ("cell", "doc_id", "n_copies", "own", "part", "items")
    members = members.select("cell", F.col("f1").alias("doc_id"), "n_copies", F.lit(True).alias("own"), F.lit(-1).alias("part"), "items")
    found = None
    add = lambda x: x if found is None else found.unionByName(x)
    counted = lambda x: scratch.keep(x.repartition("cell").sortWithinPartitions("cell", "doc_id").select(*fields).mapInArrow(_count(num, den), "f long, links long, low long"))

    def in_blocks(rest: DataFrame) -> DataFrame:
        total = rest.groupBy("cell").agg(F.greatest(F.ceil(2 * F.count("*") / max_docs), F.ceil(2 * F.sum(F.length("items") / 8) / max_items)).cast("int").alias("b"))
        dealt = rest.join(total, "cell").withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit("b")), F.col("b")).cast("int"))
        pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        return counted(pairs.withColumn("part", F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("i"))).withColumn("cell", F.concat_ws("|", "cell", F.least("i", "j"), F.greatest("i", "j"))))

    for level in range(depth + 1):
        size = scratch.keep(members.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.length("items") / 8).alias("items_n")))
        big = size.where((F.col("n") > max_docs) | (F.col("items_n") > max_items)).select("cell")
        found = add(counted(members.join(big, "cell", "left_anti")))
        if big.isEmpty():
            return found
        rest = scratch.keep(members.join(big, "cell", "left_semi"))
        if level == depth:
            return add(in_blocks(rest))
        chosen = rest.join(_pivots(rest, level, pivots), ["cell", "doc_id"], "left_semi")
        # each cell's pivots (at most `pivots` sets) meet its sets in `spread` tasks
        spread = 32
        lists = chosen.groupBy("cell").agg(F.collect_list(F.struct("doc_id", "items")).alias("pivots")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        dealt = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")).join(lists, ["cell", "salt"])
        where = dealt.select("cell", "doc_id", "items", "pivots").mapInArrow(_assign(num, den), "cell string, doc_id long, home int, near array<int>, window array<int>")
        where = scratch.keep(where.drop("near"))
        if where.agg(F.sum(F.size("window"))).first()[0] > 2 * rest.count():
            return add(in_blocks(rest))
        placed = where.join(rest.select("cell", "doc_id", "own"), ["cell", "doc_id"]).select("cell", "doc_id", F.explode("window").alias("pivot"), "home", "own")
        placed = scratch.keep(placed.select("cell", "doc_id", F.concat_ws("/", "cell", "pivot").alias("next"), (F.col("own") & (F.col("pivot") == F.col("home"))).alias("own")))
        # a cell without residents counts nothing
        live = placed.groupBy("next").agg(F.max("own").alias("any")).where("any").select("next")
        placed = placed.join(live, "next", "left_semi").join(rest.drop("own"), ["cell", "doc_id"])
        members = scratch.keep(placed.select(F.col("next").alias("cell"), "doc_id", "n_copies", "own", "part", "items"))
        scratch.drop(rest)
    return found


def linked_sets(scratch: Scratch, docs: DataFrame, k: int, num: int, den: int, max_docs: int, max_items: int, pivots: int, degrees: bool) -> tuple[DataFrame, DataFrame]:
    """Two tables for docs (doc_id, text): the fingerprint of each row, and the sets that have copies or links.

    The sets: (f1, f2, rep, component, links, chosen); rep is the smallest id of the set's rows, component that of all sets
    it is connected with, chosen holds for one set of them; links counts rows. Without `degrees` links of sets in large
    regions are not counted, as what is connected there already isn't compared.
    """
    bound_batches(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, k))
    reps = prints.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.max("n_shingles").alias("n"))
    reps = scratch.keep(reps.withColumn("node", F.coalesce("rep", "f1")))
    firsts = Bits(reps.where("rep is not null").select("rep"))
    regions = components(scratch, scratch.keep(stars(signatures(docs, firsts, k, num, den))), drop_input=True)
    regions = scratch.keep(regions.select(F.col("id").alias("node"), F.col("root").alias("region")))
    placed = scratch.keep(reps.join(regions, "node").select("f1", "f2", "rep", "node", "n_copies", "n", F.col("region").cast("string").alias("cell")))
    scratch.drop(regions)
    size = placed.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("items_n")).where("m > 1")
    size = scratch.keep(size.select("cell", ((F.col("m") > max_docs) | (F.col("items_n") > max_items)).alias("big")))
    several = scratch.keep(placed.join(size, "cell"))
    scratch.drop(placed)

    def fetch(which: DataFrame) -> DataFrame:
        """which with the text of each set; a set may come more than once."""
        wanted = Bits(which.where("rep is not null").select("rep"))

        def run(batches):
            seen: set = set()
            for b in batches:
                b = b.take(pa.array(wanted.passing(b.column(0).to_pylist())))
                at = 0
                for ids, sets in _sets(b.column(0).to_pylist(), as_bytes(b.column(1)), k):
                    f = [_print(s)[0] for s in sets]
                    node = [y if x is None else x for x, y in zip(ids, f)]
                    keep = [i for i, (x, y) in enumerate(zip(node, f)) if y is not None and (x, y) not in seen]
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.update((node[i], f[i]) for i in keep)
                    keep_at = pa.array(keep, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()).take(keep_at), pa.array(f, pa.int64()).take(keep_at), b.column(1).slice(at, len(ids)).take(keep_at)], names=["node", "f1", "text"])
                    at += len(ids)

        return docs.mapInArrow(run, "node long, f1 long, text string").join(which, ["node", "f1"]).select("cell", "f1", "f2", "rep", "n_copies", "text")

    found = fetch(several.where("not big")).repartition("cell").sortWithinPartitions("cell", "f1")
    found = scratch.keep(found.mapInArrow(_finish(k, num, den), "f1 long, f2 long, component long, links long, chosen boolean"))
    if not several.where("big").isEmpty():

        def items(batches):
            for b in batches:
                sets = [shingle_set(x.lower().split(), k).tobytes() for x in as_bytes(b.column("text"))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cell", "f1", "n_copies")), pa.nulls(len(sets), pa.string()), pa.array(sets, pa.binary())], names=["cell", "f1", "n_copies", "label", "items"])

        large = several.where("big").select("f1", "f2", "rep", "node", "n_copies", "cell")
        texts = fetch(large).dropDuplicates(["cell", "f1"])
        members = scratch.keep(texts.select("cell", "f1", "n_copies", "text").mapInArrow(items, "cell string, f1 long, n_copies long, label string, items binary"))
        members = refine(scratch, members, num, den)
        if degrees:
            linked = count_links(scratch, members, num, den, max_docs, max_items, pivots)
            edges = linked.select(F.col("f").alias("a"), F.col("low").alias("b"))
        else:
            linked = None
            edges = divide(scratch, members.withColumnRenamed("f1", "doc_id"), num, den, max_docs, max_items, pivots)
        roots = large.join(components(scratch, edges).withColumnRenamed("id", "f1"), "f1").select("f1", "f2", "rep", "root")
        best = roots.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "f1")).alias("best"))
        more = roots.join(best, "root").select("f1", "f2", F.col("best.rep").alias("component"), (F.col("f1") == F.col("best.f1")).alias("chosen"))
        if degrees:
            more = more.join(linked.groupBy(F.col("f").alias("f1")).agg(F.sum("links").alias("links")), "f1")
        else:
            more = more.withColumn("links", F.lit(0).cast("long"))
        found = found.unionByName(more)
    sets = reps.join(found, ["f1", "f2"], "left").where("n_copies > 1 or links is not null")
    links = F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))
    return prints, sets.select("f1", "f2", "rep", F.coalesce("component", "rep").alias("component"), links.alias("links"), F.coalesce("chosen", F.lit(True)).alias("chosen"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2048, max_items: int = 4_000_000, pivots: int = 32, degrees: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of docs; component_id is the smallest doc_id reachable by links.

    n_links is the number of other rows that the row links with; without `degrees` it isn't returned.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints, sets = linked_sets(Scratch(docs.sparkSession, "jaccard"), docs, k, num, den, max_docs, max_items, pivots, degrees)
    out = ["doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")]
    if degrees:
        out.append(F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return prints.join(sets, ["f1", "f2"], "left").select(*out)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2048, max_items: int = 4_000_000, pivots: int = 32) -> DataFrame:
    """One row of docs, with all its columns, for each component: that with the smallest doc_id; rows without words all stay.

    Rows whose id no linked set or copy has, which a bitmap of fixed size tells, are passed on where they are.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints, sets = linked_sets(scratch, keys, k, num, den, max_docs, max_items, pivots, degrees=False)
    sets = scratch.keep(sets)
    ids = prints.join(sets.select("f1", "f2"), ["f1", "f2"], "left_semi").where("doc_id is not null")
    touched = Bits(ids.select("doc_id"))
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    text_at = docs.columns.index(text_col)

    def alone(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[touched.passing(b.column(0).to_pylist())] = False
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(keep))], names=["row"])

    def others(batches):
        for b in batches:
            b = b.take(pa.array(touched.passing(b.column(0).to_pylist())))
            at = 0
            for ids, parts in _sets(b.column(0).to_pylist(), as_bytes(b.column(1).field(text_at)), k):
                f = [_print(x) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in f], pa.int64()), pa.array([x[1] for x in f], pa.int64()), b.column(1).slice(at, len(ids))], names=["doc_id", "f1", "f2", "row"])
                at += len(ids)

    kind = StructType([packed.schema["row"]])
    free = packed.mapInArrow(alone, kind)
    named = StructType([StructField(c, LongType()) for c in ("doc_id", "f1", "f2")] + [packed.schema["row"]])
    held = packed.mapInArrow(others, named).join(sets.select("f1", "f2", "rep", "chosen"), ["f1", "f2"], "left")
    held = scratch.keep(held.where("chosen is null or (chosen and doc_id <=> rep)"))
    first = held.where("chosen").groupBy("f1", "f2").agg(F.first("row").alias("row"))
    return free.unionByName(held.where("chosen is null").select("row")).unionByName(first.select("row")).select("row.*")
