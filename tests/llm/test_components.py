"""Connected components against a plain union-find, in rounds over the cluster and in one task."""

import random

import pytest

from tidemark.llm.near_dedup import components

R = random.Random(1)
GRAPHS = {
    "path": [(i, i + 1) for i in range(150)],
    "stars": [(0, i) for i in range(1, 200)] + [(i, 3) for i in range(150, 260)] + [(7, 7), (1000, 7), (7, 1000)],
    "random": [(R.randrange(900), R.randrange(900)) for _ in range(600)],
    "loops": [(5, 5)],
    "empty": [],
}


def plain(edges):
    label = {v: v for a, b in edges if a != b for v in (a, b)}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


@pytest.mark.parametrize("alone", [0, 10_000])
@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name, alone):
    found = components(spark.createDataFrame(GRAPHS[name], "a long, b long"), alone).collect()
    assert len(found) == len({r.v for r in found}) and {r.v: r.label for r in found} == plain(GRAPHS[name])
