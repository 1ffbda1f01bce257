import random

import pytest

from tonelake.plans.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4)], [(9, 8), (8, 7), (1, 2), (5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(None, 3), (4, None), (6, 7)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_random_and_empty(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
