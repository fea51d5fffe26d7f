"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

Encoding: blanks become U+2581 and one is put in front; all ways to cut the text into pieces of the model form a
lattice. A forward Viterbi pass gives each position its best score; these are exact heuristics for an A-star search
backward from the end, which so yields segmentations in order of their score. No piece holds U+2581 after another
character, so the lattice falls into independent segments (a run of U+2581 with what follows it); the forward pass of
each distinct segment is kept, and the search runs on those segments alone whose second-best loss is among the n - 1
smallest of the text: no other can take part in the n best. A character without a piece costs ``UNKNOWN`` and becomes
byte pieces; so does U+2581 itself, so that decoding gives the text back exactly.

Ties: the longer last piece, then the earlier expanded path. Edge cases: null text is encoded as empty: no pieces,
one segmentation of score 0; repeated rows alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_GAP = 10.0
CACHE_SEGMENTS = 20_000
#: Segments up to LOCKSTEP characters take the forward pass side by side, BLOCK of them at a time.
#: A worker keeps the forward pass of up to KEPT segments.
LOCKSTEP, BLOCK, CHUNK_SEGMENTS, KEPT = 40, 20_000, 200_000, 600_000
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Stands for a U+2581 of the text; a lone surrogate is in no valid text.
_ESCAPED = "\ud800"


class Lattice:
    """Pieces of a model file with their scores."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {self.text[i]: (i, sp.get_score(i)) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.piece), default=1)
        self.unknown = min([s for _, s in self.piece.values() if s > -1e8], default=0.0) - UNKNOWN_GAP
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(BLANK, " ").encode() for i, t in enumerate(self.text)]
        self.kept: dict[str, tuple[tuple[int, ...], float, float]] = {}
        self.lists: dict[tuple[str, int], list] = {}
        self.clear()
        assert not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.piece)

    def edges(self, s: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """Pieces that end at each position: (start, ids, score), longest first."""
        get, out = self.piece.get, [[] for _ in range(len(s) + 1)]
        for end in range(1, len(s) + 1):
            for start in range(max(0, end - self.longest), end):
                got = get(s[start:end])
                if got:
                    out[end].append((start, (got[0],), got[1]))
            if not out[end] or out[end][-1][0] != end - 1:
                c = BLANK if s[end - 1] == _ESCAPED else s[end - 1]
                out[end].append((end - 1, tuple(self.byte[b] for b in c.encode()), self.unknown))
        return out

    def best(self, s: str) -> tuple[tuple[int, ...], float, float]:
        """(ids, score, loss of the second-best segmentation) of a segment."""
        got = self.kept.get(s)
        if got is None:
            if len(self.kept) > CACHE_SEGMENTS:
                self.kept.clear()
            edges = self.edges(s)
            score, back, loss = [0.0], [None], [0.0]
            for end in range(1, len(s) + 1):
                top, second, by = -1e300, -1e300, None
                for e in edges[end]:
                    v = score[e[0]] + e[2]
                    if v > top:
                        top, second, by = v, top, e
                    elif v > second:
                        second = v
                score.append(top)
                back.append(by)
                loss.append(top - second)
            ids, at, gap = [], len(s), 1e300
            while at:
                gap = min(gap, loss[at])
                ids.append(back[at][1])
                at = back[at][0]
            got = tuple(itertools.chain.from_iterable(reversed(ids))), score[-1], gap
            self.kept[s] = got
        return got

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids) of a segment, by A-star from its end."""
        if (s, n) in self.lists:
            return self.lists[s, n]
        edges = self.edges(s)
        ahead = [0.0]
        for end in range(1, len(s) + 1):
            ahead.append(max(ahead[a] + w for a, _, w in edges[end]))
        heap, number, out = [(-ahead[-1], 0, len(s), 0.0, None)], itertools.count(1), []
        while heap and len(out) < n:
            f, _, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            for start, ids, w in edges[at]:
                heapq.heappush(heap, (-(ahead[start] + w + done), next(number), start, done + w, (ids, path)))
        if len(self.lists) > CACHE_SEGMENTS // 10:
            self.lists.clear()
        self.lists[s, n] = out
        return out

    def _table(self) -> None:
        """Hash table of the pieces for the side-by-side pass: buckets of up to `width` piece hashes."""
        self.mul = np.uint64(0x9E3779B97F4A7C15)
        pieces = sorted(self.piece.items(), key=lambda x: x[1][0])
        h = np.array([self._hash(p) for p, _ in pieces], np.uint64)
        bucket = (h >> np.uint64(46)).astype(np.int64)
        width = int(np.bincount(bucket).max())
        self.slot_hash, self.slot_id = np.zeros((width, 1 << 18), np.uint64), np.full((width, 1 << 18), -1, np.int32)
        used = np.zeros(1 << 18, np.int64)
        for x, b, (_, (i, _)) in zip(h, bucket.tolist(), pieces):
            self.slot_hash[used[b], b], self.slot_id[used[b], b] = x, i
            used[b] += 1
        self.score_of = np.full(len(self.text) + 1, -np.inf)
        for _, (i, w) in pieces:
            self.score_of[i] = w

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        return h * 0xBF58476D1CE4E5B9 % 2**64

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.done = np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0), np.empty(0)

    def look_up(self, cut: list[list[str]]) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
        """(numbers of each text's segments, best_all() of all numbered); only new segments are worked out."""
        if len(self.number) > KEPT:
            self.clear()
        number, old = self.number, len(self.number)
        give = number.setdefault
        at = [np.array([give(s, len(number)) for s in segs], np.int64) for segs in cut]
        if len(number) > old:
            new = self.best_all(list(itertools.islice(number, old, None)))
            pieces, start, score, loss = self.done
            self.done = np.concatenate((pieces, new[0])), np.concatenate((start, new[1][1:] + start[-1])), np.concatenate((score, new[2])), np.concatenate((loss, new[3]))
        return at, self.done

    def best_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each segment's ids, score, loss) of many segments; the same as best() of each."""
        if not hasattr(self, "slot_id"):
            self._table()
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        score, loss = np.zeros(len(segments)), np.zeros(len(segments))
        parts: list = [None] * len(segments)
        short = np.flatnonzero(length <= LOCKSTEP)
        short = short[np.argsort(-length[short], kind="stable")]
        for lo in range(0, len(short), BLOCK):
            self._lockstep([segments[i] for i in short[lo : lo + BLOCK]], short[lo : lo + BLOCK], parts, score, loss)
        for i in np.flatnonzero(length > LOCKSTEP):
            ids, score[i], loss[i] = self.best(segments[i])
            parts[i] = np.array(ids, np.int32)
        start = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return np.concatenate([np.empty(0, np.int32), *parts]), start, score, loss

    def _lockstep(self, segs: list[str], where: np.ndarray, parts: list, out_score: np.ndarray, out_loss: np.ndarray) -> None:
        """Forward Viterbi of segments, longest first, a position at a time."""
        n, length = len(segs), np.array([len(x) for x in segs])
        chars = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        first = np.cumsum(length) - length
        end_of = np.repeat(first + length, length)
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        pieces, longest = [], min(self.longest, int(length[0]))
        for k in range(1, longest + 1):  # pieces of k characters from each position
            at = at[at + k <= end_of[at]]
            x = (h[at] ^ chars[at + k - 1]) * self.mul
            h[at] = x ^ (x >> np.uint64(29))
            x = h[at] * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (x >> np.uint64(46)).astype(np.int64)
            found = np.full(len(chars), -1, np.int32)
            got = np.full(len(at), -1, np.int32)
            for hashes, ids in zip(self.slot_hash, self.slot_id):
                hit = hashes[bucket] == x
                got[hit] = ids[bucket[hit]]
            found[at] = got
            pieces.append(found)
        weight = [self.score_of[p] for p in pieces]  # -1 reads the last entry: none
        alone = pieces[0] < 0
        weight[0] = np.where(alone, self.unknown, weight[0])
        width = int(length[0]) + 1
        score = np.full((width, n), -1e300)
        score[0] = 0.0
        back, gap = np.zeros((width, n), np.int8), np.zeros((width, n))
        live = n
        for end in range(1, width):
            while length[live - 1] < end:
                live = int(np.searchsorted(-length, -end, "right"))
            top, second, by = np.full(live, -1e300), np.full(live, -1e300), np.zeros(live, np.int8)
            for k in range(min(longest, end), 0, -1):
                v = score[end - k, :live] + weight[k - 1][first[:live] + end - k]
                better = v > top
                second = np.where(better, top, np.maximum(second, v))
                by[better] = k
                top = np.where(better, v, top)
            score[end, :live], back[end, :live], gap[end, :live] = top, by, top - np.maximum(second, -1e300)
        out_score[where] = score[length, np.arange(n)]
        left, todo, smallest = length.copy(), np.arange(n), np.full(n, 1e300)
        steps, hold = [], []
        while len(todo):
            k = back[left[todo], todo].astype(np.int64)
            smallest[todo] = np.minimum(smallest[todo], gap[left[todo], todo])
            left[todo] -= k
            place = first[todo] + left[todo]
            ids = np.zeros(len(todo), np.int64)
            for size in np.unique(k):
                ids[k == size] = pieces[size - 1][place[k == size]]
            ids = np.where(ids < 0, -1 - chars[place].astype(np.int64), ids)
            steps.append(ids)
            hold.append(todo)
            todo = todo[left[todo] > 0]
        out_loss[where] = smallest
        # pieces came last first
        owner = np.concatenate(hold[::-1])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate(steps[::-1])[order]
        if (ids < 0).any():
            size = np.ones(len(ids), np.int64)
            raw = {i: [self.byte[b] for b in (BLANK if chr(-1 - i) == _ESCAPED else chr(-1 - i)).encode()] for i in np.unique(ids[ids < 0]).tolist()}
            bad = np.flatnonzero(ids < 0)
            size[bad] = [len(raw[i]) for i in ids[bad].tolist()]
            wide = np.repeat(ids, size)
            begin = np.cumsum(size) - size
            for i in bad.tolist():
                wide[begin[i] : begin[i] + size[i]] = raw[int(ids[i])]
            ids, owner = wide, np.repeat(owner[order], size)
        else:
            owner = owner[order]
        cut = np.searchsorted(owner, np.arange(n + 1))
        ids = ids.astype(np.int32)
        for j, i in enumerate(where.tolist()):
            parts[i] = ids[cut[j] : cut[j + 1]]

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _SEGMENT.findall(BLANK + text.replace(BLANK, _ESCAPED).replace(" ", BLANK))

    def combine(self, segments: list[str], score: np.ndarray, loss: np.ndarray, n: int) -> list[tuple[float, tuple]]:
        """The n best combinations of a text's segments: (score, ((segment, rank), ...)), rank 0 left out."""
        total = float(score.sum())
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        if n > 1 and len(segments):
            if len(loss) >= n:  # of equal losses the first of the text
                edge = np.partition(loss, n - 2)[n - 2]
                near = np.concatenate((np.flatnonzero(loss < edge), np.flatnonzero(loss == edge)))[: n - 1]
            else:
                near = np.arange(len(loss))
            for i in sorted(near.tolist()):
                options = self.nbest(segments[i], n)
                ways = sorted(((w + s - options[0][0], (*c, (i, k)) if k else c) for w, c in ways for k, (s, _) in enumerate(options)), key=lambda x: -x[0])[:n]
        return [(total + d, c) for d, c in ways]

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text: (score, ids), best first."""
        segments = self.segments(text)
        best = [self.best(s) for s in segments]
        ways = self.combine(segments, np.array([b[1] for b in best]), np.array([b[2] for b in best]), n)
        out = []
        for score, choice in ways:
            other = {i: self.nbest(segments[i], n)[k][1] for i, k in choice}
            out.append((score, list(itertools.chain.from_iterable([other.get(i, b[0]) for i, b in enumerate(best)]))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and byte pieces joined, without the blank put in front."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


_lattices: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    """One per worker process."""
    if model not in _lattices:
        _lattices[model] = Lattice(model)
    return _lattices[model]


_EDITS = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _encoded(lat: Lattice, ids: pa.Array, texts: list, cut: list[list[str]], n: int, id_col: str) -> pa.RecordBatch:
    """Rows of encode() for some texts and their segments; each distinct segment is worked out once."""
    at, (pieces, start, score, loss) = lat.look_up(cut)
    size = np.diff(start)
    out: dict[str, list] = {"ids": [], "score": [], "losses": [], "edits": [], "lossless": []}
    for t, segs, a in zip(texts, cut, at):
        k = size[a]
        own = pieces[np.repeat(start[:-1][a] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        ways = lat.combine(segs, score[a], loss[a], n)
        # other segmentations differ in a few segments, which must stand for the same bytes
        raw = lambda x: b"".join(map(lat.raw.__getitem__, x))
        same = all(raw(lat.nbest(segs[i], n)[r][1]) == raw(lat.nbest(segs[i], n)[0][1]) for _, c in ways[1:] for i, r in c)
        out["ids"].append(own)
        out["score"].append(ways[0][0])
        out["losses"].append([ways[0][0] - s for s, _ in ways[1:]])
        end = np.cumsum(k)
        out["edits"].append([[{"start": int(end[i] - k[i]), "end": int(end[i]), "ids": lat.nbest(segs[i], n)[r][1]} for i, r in c] for _, c in ways[1:]])
        out["lossless"].append(same and lat.decode(own.tolist()) == (t or ""))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in out["ids"]]))).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *out["ids"]])))
    return pa.RecordBatch.from_arrays([ids, flat, pa.array(out["score"], pa.float64()), pa.array(out["losses"], pa.list_(pa.float64())), pa.array(out["edits"], _EDITS), pa.array(out["lossless"], pa.bool_())], names=[id_col, "ids", "score", "losses", "edits", "lossless"])


def encode(docs: DataFrame, n: int = 4, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, score, losses, edits, lossless): best ids, their score, how much each of the next n - 1 segmentations
    loses and where it has other ids than the best (nbest_ids() gives them whole), whether all of them decode to the text."""
    assert Path(model).exists() or not model.startswith("/"), model

    def run(batches):
        enter("sentencepiece", _lattices.clear)
        lat = lattice(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            lo, held, cut = 0, 0, []
            for i, t in enumerate(texts):
                cut.append(lat.segments(t))
                held += len(cut[-1])
                if held >= CHUNK_SEGMENTS or i + 1 == len(texts):
                    yield _encoded(lat, b.column(0).slice(lo, len(cut)), texts[lo : i + 1], cut, n, id_col)
                    lo, held, cut = i + 1, 0, []

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>, score double, losses array<double>, edits array<array<struct<start:int,end:int,ids:array<int>>>>, lossless boolean")


def nbest_ids(ids: str = "ids", edits: str = "edits"):
    """Column of the ids of all segmentations, best first, from encode()'s ids and edits."""
    one = f"""aggregate(e, named_struct('out', cast(array() as array<int>), 'at', 0),
        (a, x) -> named_struct('out', concat(a.out, slice({ids}, a.at + 1, x.start - a.at), x.ids), 'at', x.end),
        a -> concat(a.out, slice({ids}, a.at + 1, size({ids}) - a.at)))"""
    return F.concat(F.array(F.col(ids)), F.expr(f"transform({edits}, e -> {one})"))


def ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
