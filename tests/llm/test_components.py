import random

from postmill.llm.common import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in brute(edges).items()}
    assert got == {k: v for k, v in want.items() if k in got}
    assert all(v == k for k, v in want.items() if k not in got)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
