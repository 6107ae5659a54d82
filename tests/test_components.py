"""Connected components against a plain version."""

import random

import pytest

from logshape.operators.components import components


def plain(edges):
    label = {}

    def root(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: root(i) for i in label}


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2), (3, None)], [(5, 1), (1, 5), (7, 1), (9, 1)], [(i, i + 1) for i in range(40)], [(4, 2), (4, 3), (3, 1)],
    [(random.Random(3).randrange(60), random.Random(i).randrange(60)) for i in range(30)], [(a, b) for a in range(6) for b in range(6)],
])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r.node: r.label for r in got} == plain(edges) and len(got) == len(plain(edges))
