"""Documents that quote common passages: candidates of the set join in large regions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lineloom.llm import jaccard_join
from lineloom.llm.common import shingle_set


def quoting(n: int, seed: int = 5) -> list[tuple[int, str]]:
    """Texts of words of their own around one passage, a near copy of every tenth, and one text that only quotes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage, rows = [word() for _ in range(60)], []
    for i in range(n):
        own = [word() for _ in range(60)]
        rows.append((len(rows), " ".join(own[:30] + passage + own[30:])))
        if i % 10 == 0:
            rows.append((len(rows), " ".join([*own[:30], *passage, *own[30:-2], word()])))
    return [*rows, (len(rows), " ".join(passage))]


def brute(rows: list[tuple[int, str]], num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = [shingle_set(t.encode().split(), 5) for _, t in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j], assume_unique=True))
            near[i, j] = near[j, i] = den * both >= num * (len(x) + len(sets[j]) - both)
    low = np.arange(len(rows))
    for _ in rows:
        low = np.minimum(low, np.where(near, low[None], len(rows)).min(1))
    return {i: (int(low[i]), int(near[i].sum())) for i, _ in rows}


@pytest.mark.parametrize("degrees", [False, True])
def test_common_passages_need_no_pairs_of_blocks(spark, monkeypatch, degrees):
    """A region that a passage alone holds together comes apart; before, each of its sets met all others, block by block."""
    rows, sizes = quoting(120), []
    count = jaccard_join.count_links
    monkeypatch.setattr(jaccard_join, "blocks", lambda *a: pytest.fail("compared in pairs of blocks"))
    monkeypatch.setattr(jaccard_join, "count_links", lambda scratch, members, *a: sizes.append(members.count()) or count(scratch, members, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, max_docs=16, pivots=4, degrees=degrees).collect()}
    want = brute(rows, 80, 100)
    assert {i: r.component_id for i, r in got.items()} == {i: c for i, (c, _) in want.items()}
    assert sum(n > 0 for _, n in want.values()) == 24
    if degrees:
        assert {i: r.n_links for i, r in got.items()} == {i: n for i, (_, n) in want.items()}
        assert sizes == [24]


def test_first_elements_of_linked_sets_meet():
    class Held:
        def __init__(self, ids):
            self.ids = ids

        def passing(self, x):
            return np.flatnonzero(np.isin(x, self.ids))

    r = np.random.default_rng(4)
    for num, den in ((80, 100), (85, 100), (1, 2)):
        for _ in range(200):
            x = np.unique(r.integers(0, 1 << 60, r.integers(1, 60)).astype(np.uint64))
            y = np.unique(np.concatenate((x[r.random(len(x)) < 0.9], r.integers(0, 1 << 60, 4).astype(np.uint64))))
            both = np.intersect1d(x, y)
            more = np.concatenate((both, r.choice(x, 3), r.choice(y, 3))).view(np.int64)
            tiers = [Held(more), Held(r.permutation(more)[: len(more) // 2])]
            if len(both) and den * len(both) >= num * (len(x) + len(y) - len(both)):
                assert np.intersect1d(jaccard_join._first(x, tiers, num, den), jaccard_join._first(y, tiers, num, den)).size
