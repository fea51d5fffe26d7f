"""Connected components against a search, for graphs of one task and of many."""

from __future__ import annotations

import random

import pytest

from lineloom.llm.common import Scratch, components


def search(links: list[tuple]) -> dict[int, int]:
    near: dict[int, list[int]] = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    root: dict[int, int] = {}
    for first in sorted(near):
        todo = [first] if first not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = first
                todo += near[x]
    return root


def graphs() -> list[list[tuple]]:
    r = random.Random(3)
    some = list(range(-40, 160))
    r.shuffle(some)
    path = list(zip(some, some[1:]))
    hub = [(7, i) for i in range(60)] + [(1000, i) for i in range(59, 90)]
    loose = [(r.randrange(120), r.randrange(120)) for _ in range(90)]
    return [path, hub, [*loose, (None, 3), (4, None), (5, 5), *loose[:9]], [(9, 9)], []]


@pytest.mark.parametrize("held", [4, 30, 1 << 19])
def test_components_equal_search(spark, held):
    for links in graphs():
        df = spark.createDataFrame(links, "a long, b long").repartition(5)
        got = components(Scratch(spark, "test"), df, held=held).collect()
        assert len(got) == len({r.id for r in got}) and {r.id: r.root for r in got} == search(links)


def test_a_small_graph_takes_one_table(spark):
    """It took three tables and a count for each round, and a round more to see that nothing changes: 15 seconds each over 211 partitions."""
    scratch, links = Scratch(spark, "test"), graphs()[0]
    got = components(scratch, spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.root for r in got.collect()} == search(links)
    assert scratch.n == 1
