"""Connected components against union-find, on shapes that take many rounds or have hubs."""

import random

import pytest

from stemma.llm import components


def want(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def shapes():
    r = random.Random(1)
    path = list(range(400))
    r.shuffle(path)
    return {
        "nothing": [],
        "loops": [(3, 3)],
        "path": list(zip(path, path[1:], strict=False)),
        "falling": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 300)],
        "star of the largest": [(999, i) for i in range(1, 300)] + [(2, 1)],
        "random": [(r.randrange(3000), r.randrange(3000)) for _ in range(2000)],
        "negative": [(-5, 7), (7, 2**60), (-(2**60), 2**60)],
    }


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("batch", [1, 1 << 20])
def test_components(spark, monkeypatch, name, batch):
    monkeypatch.setattr(components, "BATCH", batch)
    links = shapes()[name]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = components.components(df).collect()
    assert {x["id"]: x["component"] for x in got} == want(links)
    assert len(got) == len(want(links))
