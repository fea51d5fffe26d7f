"""Piecewise fingerprints against brute force."""

import hashlib
import random

import pytest

from lineloom.llm import piecewise
from lineloom.llm.common import mix

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def brute_fingerprint(text):
    import numpy as np

    value = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32).tolist()
    hashes = mix(np.arange(1001, 1257, dtype=np.uint64)).tolist()
    data = (text or "").encode()
    level = []
    for i in range(len(data)):
        h = sum(value[data[i - j]] * 0x01000193**j for j in range(min(7, i + 1))) & M32
        h ^= h >> 15
        h = h * 0x2C1B3C6D & M32
        h ^= h >> 13
        level.append(next((k for k in range(32) if not h >> k & 1), 32))

    def pieces(bits):
        out, start = [], 0
        for i in range(len(data)):
            if level[i] >= bits or i == len(data) - 1:
                out.append(data[start : i + 1])
                start = i + 1
        return out

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def sign(bits):
        s = ""
        for p in pieces(bits):
            h = sum(hashes[c] * pow(piecewise.FACTOR, i, 1 << 64) for i, c in enumerate(p)) & M64
            h = (h * 0x9E3779B97F4A7C15 & M64) >> 52
            s += letters[h >> 6] + letters[h & 63]
        return s

    bits = next(k for k in range(2, 34) if len(pieces(k)) <= 64)
    return f"{bits}:{sign(bits)}:{sign(bits + 1)}:{sign(bits + 2)}"


def brute_likeness(a, b):
    if a == b:
        return 1.0
    (k, *x), (m, *y) = a.split(":"), b.split(":")
    found = [0.0]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            p2, q2 = [p[n : n + 2] for n in range(0, len(p), 2)], [q[n : n + 2] for n in range(0, len(q), 2)]
            if int(k) + i == int(m) + j and p2 and q2:
                d = {(-1, n): n + 1 for n in range(-1, len(q2))} | {(n, -1): n + 1 for n in range(len(p2))}
                for r, u in enumerate(p2):
                    for c, v in enumerate(q2):
                        d[r, c] = min(d[r - 1, c] + 1, d[r, c - 1] + 1, d[r - 1, c - 1] + 2 * (u != v))
                found.append(1 - d[len(p2) - 1, len(q2) - 1] / (len(p2) + len(q2)))
    return max(found)


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefg éß語😀 \n") for _ in range(r.choice([0, 1, 2, 7, 9, 60, 300, 3000]))) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_fingerprints_equal_brute_force(block, monkeypatch):
    monkeypatch.setattr(piecewise, "BLOCK_BYTES", block)
    piecewise._tables.clear()
    for t in [*texts(1, 40), "a" * 5000, "ab" * 700, None]:
        assert piecewise.fingerprint(t) == brute_fingerprint(t)
    piecewise._tables.clear()


def test_likeness_equals_brute_force():
    marks = [piecewise.fingerprint(t) for t in texts(2, 12)]
    base = texts(3, 30)[-1] + "word " * 9 + "".join(map(str, range(400)))
    marks += [piecewise.fingerprint(base[: len(base) * i // 9] + str(i) + base[len(base) * i // 9 :]) for i in range(9)]
    for a in marks:
        for b in marks:
            assert piecewise.likeness(a, b) == pytest.approx(brute_likeness(a, b))
    assert piecewise.fingerprint("") == piecewise.fingerprint(None) == "2:::"


def test_query_of_fingerprints_equals_brute_force(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(5, 90))] + [(-4, None), (-5, ""), (7, "same"), (7, "same"), (10, "same"), (None, "no id"), (11, "x" * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, _part int").repartition(5)
    got = piecewise.against_next(docs).collect()
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(10**9)))
    want = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        a, b, c = map(piecewise.fingerprint, (t, new, nxt))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, piecewise.likeness(a, b), piecewise.likeness(a, c)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert piecewise.against_next(docs.limit(0)).count() == 0
    one = piecewise.against_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(4, 1.0)] and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert {r.fingerprint for r in piecewise.fingerprints(docs.where("text = 'same'")).collect()} == {piecewise.fingerprint("same")}
