"""Tiered search against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lineloom.llm import tiered_search
from lineloom.llm.decontaminate import words


def brute(docs, items, top):
    rows = [(i, Counter(words((t or "").encode()))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        asked = words((text or "").encode())
        found = []
        for i, c, n in rows:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if s > 0:
                found.append((i, s))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(found[:top])]
    return sorted(out, key=repr)


def rows(seed, n_docs=120, n_items=12):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 300}"
    docs = [(i * 3 - 50, " ".join(word() for _ in range(r.choice([0, 1, 5, 30, 200])))) for i in range(n_docs)]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 20])))) for i in range(n_items)]
    docs += [(1000 + i, f"{items[1][1]} {word()}") for i in range(30)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"cuts": ()}, {"cuts": (0.4, 0.2, 0.1, 0.01)}, {"block_terms": 5}])
def test_search_equals_brute_force(spark, monkeypatch, how):
    monkeypatch.setattr(tiered_search, "SEGMENT_DOCS", 9)
    monkeypatch.setattr(tiered_search, "CELLS", 40)
    docs, items = rows(len(how))
    docs += [(7, None), (8, ""), (9, ".,;"), (None, items[2][1]), (None, "W1 w2"), (10, "Same Text"), (10, "same, text"), (11, "w1 " * 3000)]
    items += [(None, "w1 W2, w2"), (99, ""), (98, None), (97, "unheard of"), (3, "same"), (3, "same")]
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, score string").repartition(3)
    got = tiered_search.ranked(d, spark.createDataFrame(items, "item_id long, text string"), top=7, **how)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert tiered_search.ranked(none, some).count() == 0
    assert tiered_search.ranked(some.withColumnRenamed("item_id", "doc_id"), some.limit(0)).count() == 0


def test_items_fall_through_only_without_proof():
    r = np.random.default_rng(5)
    n_docs, n_terms = 300, 40
    seen = np.sort(r.choice(n_docs * n_terms, 4000, replace=False))
    # a document has a term more often the larger its number; terms are rarer the smaller theirs
    seen = seen[(seen % n_terms) / n_terms > r.random(len(seen)) * 0.9]
    terms, tf = seen % n_terms, r.integers(1, 9, len(seen))
    ends = np.searchsorted(seen, np.arange(1, n_docs + 1) * n_terms)
    n = np.maximum(1, np.diff(ends, prepend=0) * 3)
    weight = tiered_search.weights(n_docs, np.bincount(terms, minlength=n_terms))
    items = tiered_search.Items([[0, 1, 39, 38], [39], [5, 5, 20, 37], []], weight)
    full, _ = tiered_search.tiers(n, ends, terms, tf, weight, n_docs, int(n.sum()), ())
    exact = {i: dict(zip(d.tolist(), s.tolist())) for i, d, s, _ in tiered_search.segment_scores(items, full, [], n_docs, np.zeros(4, np.int64))}
    gives = full[0][3] * np.repeat(weight[full[0][0]], np.diff(full[0][1], prepend=0)) / (math.floor(1000 * math.log(2 * n_docs + 2)) * 10**6)
    parts, rests = tiered_search.tiers(n, ends, terms, tf, weight, n_docs, int(n.sum()), tuple(np.quantile(gives, (0.9, 0.6, 0.3))))
    assert all(len(p[2]) > len(seen) // 20 for p in parts)
    # bounds hold for every posting below
    for j, (own, bound) in enumerate(rests):
        for t, b in zip(own.tolist(), bound.tolist()):
            below = [x for p in parts[j + 1 :] for k, e, c in zip(p[0].tolist(), p[1].tolist(), np.diff(p[1], prepend=0).tolist()) if k == t for x in p[3][e - c : e].tolist()]
            assert max(below) == b
    for k in (1, 5, 50):
        must = np.array([sorted(exact.get(i, {0: 0}).values())[-k:][0] for i in range(4)], np.int64)
        got = {i: (dict(zip(d.tolist(), s.tolist())), depth) for i, d, s, depth in tiered_search.segment_scores(items, parts, rests, n_docs, must)}
        for i, want in exact.items():
            assert got[i][0] == {d: s for d, s in want.items() if s >= must[i]}
    out_of_reach = np.array([10**15] * 4)
    assert list(tiered_search.segment_scores(items, parts, rests, n_docs, out_of_reach)) == []


def test_large_sums_stay_whole():
    where, values = np.array([0, 1, 0]), np.array([2**60 + 1, 5, 2**60], np.int64)
    assert tiered_search.sums(where, values, 2).tolist() == [2**61 + 1, 5]
