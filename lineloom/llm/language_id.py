"""Language identification by cross-parsing entropy.

A suffix automaton holds labelled text of each language. A text, as lower-case letters with single blanks between runs
of them, is parsed from end to end against each automaton into phrases, each the longest match from where the last
ended (or one unknown letter). A phrase costs log2 of the training text's length; the language with the fewest bits a
letter wins. Texts of a batch are parsed side by side, one letter of all of them at a time; the few that are left when
the others have ended go on alone.

Training text: labelled documents with letters, in hash order, up to ``train_chars`` letters and blanks a language, the only bound; the
document with which that is reached is cut there. The model has a text of that size for every language that is named. Score: the runner-up's share of the bits of the best two (0.5 no difference,
1 at most); 1 if there is one language.

Edge cases: null text, or text without letters (Unicode L), is ``und`` with score 0; so is everything where nothing is
labelled; ties go to the first language in order; repeated rows are scored alike; rows without id, language or text
aren't learned from, and of an id that stands several times one text is; very long texts are parsed whole; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import enter

TRAIN_CHARS, SALTS = 40_000, 16
#: Characters that become codes at a time.
PIECE_CHARS = 1_000_000
#: Texts still being parsed below which they go on one by one.
FEW = 150


@cache
def _kinds() -> np.ndarray:
    """1 for letters, 2 for marks that combine with them, 0 for other code points."""
    of = {"L": 1, "M": 2}
    return np.array([of.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, length of each text): lower-case words of letters and their marks, a blank before, between and after.

    Nothing remains of a text without letters.
    """
    low = [(t or "").lower() for t in texts]
    x = np.frombuffer(("\n" + "\n\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[x]
    base = np.maximum.accumulate(np.where(kind != 2, np.arange(len(x)), 0))
    kept = kind[base] == 1
    opens = np.cumsum([0, *(len(t) + 2 for t in low[:-1])]) if low else np.empty(0, np.int64)
    size = np.array([len(t) + 2 for t in low], np.int64)
    out = kept.copy()
    out[1:] |= kept[:-1]
    if len(low):
        out[opens[np.add.reduceat(kept, opens, dtype=np.int64) > 0]] = True
    count = np.add.reduceat(out, opens, dtype=np.int64) if len(low) else size
    return np.where(kept, x, ord(" "))[out], count


def plain(text: str | None) -> str:
    """letters() of one text."""
    return letters([text])[0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class SuffixAutomaton:
    """Smallest automaton of all substrings of a text; a walk from the start gives longest matches."""

    def __init__(self, text):
        """text: any sequence of symbols."""
        self.next: list[dict] = [{}]
        self.length = len(text)
        link, size, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
            last = new

    def phrases(self, text, state: int = 0) -> int:
        """Phrases of the greedy parse that end in text, the last one included; `state` is where an earlier part ended."""
        step, n = self.next, 0
        for c in text:
            to = step[state].get(c)
            if to is None:
                n += state != 0
                to = step[0].get(c, 0)
                n += to == 0
            state = to
        return n + (state != 0)


class Model:
    """Automata of all languages, and one hashed table of their transitions."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        chars = sorted({c for t in texts.values() for c in t})
        self.code = np.zeros(sys.maxunicode + 1, np.uint16 if len(chars) < 1 << 16 else np.uint32)  # 0: in no language
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.automata = [SuffixAutomaton([int(self.code[ord(c)]) for c in texts[x]]) for x in self.langs]
        self.bits = np.array([np.log2(max(2, a.length)) for a in self.automata])
        self.width = len(chars) + 1
        self.root = np.cumsum([0, *(len(a.next) for a in self.automata)])[:-1]
        edges = [(int(r + s) * self.width + c, int(r + to)) for r, a in zip(self.root, self.automata) for s, out in enumerate(a.next) for c, to in out.items()]
        key, to = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.empty(0, np.int64),) * 2
        self.shift = np.uint64(64 - max(4, (2 * len(key)).bit_length()))
        self.key, self.to = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.zeros(1 << (64 - int(self.shift)), np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            first = np.unique(at[todo], return_index=True)[1]
            first = first[self.key[at[todo[first]]] < 0]
            put = todo[first]
            self.key[at[put]], self.to[at[put]] = key[put], to[put]
            todo = np.delete(todo, first)
            at[todo] = (at[todo] + 1) % len(self.key)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none."""
        key = state * self.width + code
        at = self._slot(key)
        have = self.key[at]
        out = np.where(have == key, self.to[at], -1)
        todo = np.flatnonzero((have != key) & (have >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.key)
            have = self.key[at[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out

    def phrases(self, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); codes of the texts in a row, and their lengths."""
        total = np.zeros((len(length), len(self.langs)), np.int64)
        order = np.argsort(-length, kind="stable")
        size = length[order]
        start = (np.cumsum(length) - length)[order]
        state = np.repeat(self.root[None], len(length), 0)
        n, live, at = np.zeros_like(total), len(length), 0
        while live >= FEW:
            live = int(np.searchsorted(-size, -at, "left"))  # texts longer than `at`
            if live < FEW:
                break
            code = np.repeat(flat[start[:live] + at].astype(np.int64), len(self.langs))
            now = state[:live].ravel()
            root = np.broadcast_to(self.root, (live, len(self.langs))).ravel()
            to = self.step(now, code)
            lost = np.flatnonzero(to < 0)
            if len(lost):
                again = self.step(root[lost], code[lost])
                unknown = again < 0
                n[:live].reshape(-1)[lost] += (now[lost] != root[lost]).astype(np.int64) + unknown
                to[lost] = np.where(unknown, root[lost], again)
            state[:live] = to.reshape(live, -1)
            at += 1
        for i in range(len(length)):
            rest = flat[start[i] + at : start[i] + size[i]].tolist() if size[i] > at else ()
            for j, a in enumerate(self.automata):
                s = int(state[i, j] - self.root[j])
                total[order[i], j] = n[i, j] + (a.phrases(rest, s) if rest else s != 0)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        codes, sizes = [np.empty(0, self.code.dtype)], [np.empty(0, np.int64)]
        lo, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= PIECE_CHARS or i + 1 == len(texts):
                x, n = letters(texts[lo : i + 1])
                codes.append(self.code[x])
                sizes.append(n)
                lo, held = i + 1, 0
        flat, length = np.concatenate(codes), np.concatenate(sizes)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not len(flat) or not self.langs:
            return out
        some = np.flatnonzero(length)
        cost = self.phrases(flat, length[some]) * self.bits
        order = np.argsort(cost, 1, kind="stable")
        for i, c, o in zip(some.tolist(), cost, order):
            out[i] = (self.langs[o[0]], 1.0 if len(o) == 1 else float(c[o[1]] / (c[o[0]] + c[o[1]])))
        return out


_models: dict[int, Model] = {}


def model_of(texts: dict[str, str]) -> Model:
    """One model per worker process."""
    enter("language", _models.clear)
    key = hash(tuple(sorted(texts.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def training_texts(labelled: DataFrame, train_chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Words of each language's labelled documents (doc_id, text, lang), by hash of the id, up to train_chars letters."""
    letters_in = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").groupBy("lang", "doc_id").agg(F.min_by(letters_in, F.xxhash64("text")).alias("n"))
    rows = rows.where("n > 0").withColumn("h", F.xxhash64("doc_id"))
    # what a language takes is among what each of its parts would take alone
    for group in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):
        before = F.sum("n").over(Window.partitionBy(*group).orderBy("h", "doc_id")) - F.col("n")
        rows = rows.withColumn("before", before).where(F.col("before") < train_chars)
    few = rows.select("doc_id", "lang", "h")
    # documents of train_chars letters a language at most, and the one with which that is reached
    got = labelled.join(F.broadcast(few), ["doc_id", "lang"]).groupBy("lang", "h", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    out: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], r["doc_id"])):
        seen = out.setdefault(r["lang"], [])
        for word in plain(r["text"]).split():
            if size.get(r["lang"], 0) < train_chars:
                seen.append(word)
                size[r["lang"]] = size.get(r["lang"], 0) + len(word) + 1
    return {k: " " + " ".join(v) + " " for k, v in out.items() if v}


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""

    def run(batches):
        model = model_of(texts)
        for b in batches:
            got = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
