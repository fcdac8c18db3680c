"""Connected components against a union-find, in one task and in many."""

import numpy as np
import pytest

from chronopanel.operators import components as cc

import __spark_entry__  # noqa: F401  functions travel by value


def least(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


def shapes():
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(300)]
    shuffled = rng.permutation(300).tolist()
    yield "chain", chain
    yield "shuffled chain", [(shuffled[i], shuffled[i + 1]) for i in range(299)]
    yield "star", [(0, i) for i in range(1, 400)] + [(500, i) for i in range(501, 800)] + [(799, 3)]
    yield "star with a large centre", [(10**12, i) for i in range(400)]
    yield "random", [tuple(x) for x in rng.integers(-400, 400, (350, 2)).tolist()]
    yield "loops, nulls and repeats", [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5), (-(1 << 63), (1 << 63) - 1)]
    yield "empty", []


@pytest.mark.parametrize("name,edges,task_links", [(n, e, t) for n, e in shapes() for t in (cc.TASK_LINKS, 150) if len(e) > 99 or t > 150])
def test_components(spark, name, edges, task_links):
    got = cc.components(spark.createDataFrame(edges, "a long, b long"), task_links=task_links).collect()
    want = least([e for e in edges if None not in e])
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


def test_components_settle_in_few_rounds(spark, monkeypatch):
    rng, rounds = np.random.default_rng(5), []
    joined = cc._joined
    monkeypatch.setattr(cc, "_joined", lambda d: rounds.append(1) or joined(d))
    n = 50_000
    edges = spark.range(n).selectExpr("id AS a", f"abs(hash(id)) % (id div 50 + 1) AS b")
    got = cc.components(edges, task_links=20_000)
    assert got.where("root <> 0").isEmpty() and got.count() == n - 1 and len(rounds) <= 6
