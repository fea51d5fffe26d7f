"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from lineloom.llm import periodic_runs


def brute_runs(w, min_length=24, min_repeats=3):
    """Maximal stretches of every period, without those of which a shorter period is one too."""
    found = {}
    for q in range(1, len(w) // min_repeats + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(min_length, min_repeats * q) and (i - q, j - i + q) not in found:
                found[i - q, j - i + q] = q
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(seed, n=60):
    r = random.Random(seed)
    for i in range(n):
        w = [f"w{r.randrange(r.choice([1, 2, 3, 40]))}" for _ in range(r.randrange(50))]
        for _ in range(r.randrange(4)):
            unit = [f"w{r.randrange(r.choice([2, 30]))}" for _ in range(r.choice([1, 2, 5, 8, 9, 20]))]
            w += (unit * 9)[: r.randrange(9 * len(unit))] + w[: r.randrange(30)]
        yield i, " ".join(w)


@pytest.mark.parametrize("shape", [(24, 3), (10, 2), (6, 3), (40, 5)])
def test_runs_equal_brute_force(shape):
    docs = [t.encode().split() for s in range(5) for _, t in texts(s)]
    assert periodic_runs.all_runs(docs, *shape) == [brute_runs(w, *shape) for w in docs]


def test_runs_across_blocks_of_a_set(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 3)
    docs = [t.encode().split() for s in range(5, 9) for _, t in texts(s)] + [[b"a"] * 300]
    assert periodic_runs.all_runs(docs) == [brute_runs(w) for w in docs]


def test_ordered_sets_keep_neighbours(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    order = random.Random(1).sample(range(500), 500)
    held, have = periodic_runs.Ordered(order[0]), [order[0]]
    for p in order[1:]:
        want = max((x for x in have if x < p), default=None), min((x for x in have if x > p), default=None)
        assert held.add(p) == want
        have.append(p)
    assert list(held) == sorted(have)


def test_query_of_runs_equals_brute_force(spark):
    rows = [(i * 7 - 100, t) for i, t in texts(20, 150)] + [(900, None), (901, ""), (902, " \n\t "), (903, "a\x0bb \x0cc d " * 40), (900, "x y " * 30), (900, "x y " * 30), (904, "one " * 20_000)]
    rows += [(i, f"a{i} b c d e " * 12) for i in range(1000, 1100)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, runs int")
    got = periodic_runs.report(periodic_runs.find(periodic_runs.repeated_tail(docs))).collect()
    assert sorted(map(tuple, got)) == sorted(brute_row(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 100
    none = spark.createDataFrame([(None, "a " * 30), (None, None)], "doc_id long, text string")
    assert sorted(r.n_runs for r in periodic_runs.report(periodic_runs.find(periodic_runs.repeated_tail(none))).collect()) == [0, 1]
    assert periodic_runs.find(docs.limit(0)).count() == 0
