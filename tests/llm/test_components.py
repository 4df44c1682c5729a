"""Connected components by stars and in one task, against a plain search."""

import random

import pytest

from lintel.llm.components import connected_components


@pytest.mark.parametrize("bound", [0, 50_000])
def test_components(spark, bound):
    rnd = random.Random(3)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(25)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), bound=bound).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long"), bound=bound).collect() == []
