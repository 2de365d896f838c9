import random

import pytest

from churnspark.llm.graph import components


def brute_force(edges):
    group = {}

    def find(v):
        while group.setdefault(v, v) != v:
            v = group[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            group[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in group}


CHAIN = [(k, k + 1) for k in range(60)]
random.Random(1).shuffle(CHAIN)


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(None, 1), (2, None)], [(2, 1), (1, 2), (2, 1)], CHAIN, [(99, k) for k in range(40)],
    [(random.Random(k).randrange(80), random.Random(-k - 1).randrange(80)) for k in range(70)],
])
def test_like_union_find(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(frame).collect()} == brute_force(edges)
