"""Node arrays and Shapley values of tree ensembles against plain recursion."""

import itertools
import math
import time

import numpy as np
import pytest

from chronopanel.operators import trees


def grown(rng, depth, columns, n_trees, spread=0.9):
    """Random ragged trees whose covers add up."""
    root, rows = [], []

    def grow(level, cover):
        at = len(rows)
        rows.append(None)
        if level == depth or cover < 2 or rng.random() > spread:
            rows[at] = (-1, 0.0, -1, -1, rng.normal(), cover)
            return at
        part = int(rng.integers(1, cover))
        f, cut = int(rng.integers(columns)), rng.normal()
        left, right = grow(level + 1, part), grow(level + 1, cover - part)
        rows[at] = (f, cut, left, right, rng.normal(), cover)
        return at

    for _ in range(n_trees):
        root.append(grow(0, 5000))
    feature, cut, left, right, value, cover = zip(*rows)
    return trees.NodeTable(np.array(root), np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value),
                           np.array(cover, float), rng.random(n_trees))


def expected(nodes, at, row, known):
    """Mean of a tree where only the features in ``known`` are looked at."""
    if nodes.left[at] < 0:
        return nodes.value[at]
    l, r, f = nodes.left[at], nodes.right[at], nodes.feature[at]
    if f in known:
        return expected(nodes, l if row[f] <= nodes.threshold[at] else r, row, known)
    return sum(nodes.cover[c] / nodes.cover[at] * expected(nodes, c, row, known) for c in (l, r))


@pytest.mark.parametrize("depth,columns,rows", [(4, 3, 2), (4, 3, 40), (6, 5, 12), (0, 2, 3), (1, 1, 3)])
def test_shapley_values_by_definition(depth, columns, rows):
    rng = np.random.default_rng(depth * 10 + columns)
    nodes, x = grown(rng, depth, columns, 3), rng.normal(size=(rows, columns))
    got, base = trees.shapley(nodes, x)
    mean = lambda row, known: sum(w * expected(nodes, a, row, known) for w, a in zip(nodes.weight, nodes.root))
    assert base == pytest.approx(mean(x[0], ()))
    for row, phi in list(zip(x, got))[:4]:
        for i in range(columns):
            rest, want = [j for j in range(columns) if j != i], 0.0
            for k in range(columns):
                for s in itertools.combinations(rest, k):
                    want += math.factorial(k) * math.factorial(columns - k - 1) / math.factorial(columns) * (mean(row, (*s, i)) - mean(row, s))
            assert phi[i] == pytest.approx(want, abs=1e-10)
    np.testing.assert_allclose(got.sum(axis=1) + base, nodes.predict(x), atol=1e-9)


def test_many_features_on_a_path():
    rng = np.random.default_rng(9)
    nodes, x = grown(rng, 14, 12, 4), rng.normal(size=(300, 12))
    x[0, 0] = np.nan
    assert any(f.shape[1] > 8 for t in range(4) for f, *_ in trees.leaf_groups(nodes, t, 12))
    got, base = trees.shapley(nodes, x[1:])
    np.testing.assert_allclose(got.sum(axis=1) + base, nodes.predict(x[1:]), atol=1e-9)
    assert np.isfinite(nodes.predict(x)).all()


def test_no_rows_and_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    nodes, x = grown(rng, 6, 3, 5), rng.normal(size=(50, 3))
    whole, (shares, _) = nodes.predict(x), trees.shapley(nodes, x)
    assert len(nodes.predict(x[:0])) == 0 and trees.shapley(nodes, x[:0])[0].shape == (0, 3)
    monkeypatch.setattr(trees, "CELLS", 40)
    np.testing.assert_allclose(nodes.predict(x), whole)
    np.testing.assert_allclose(trees.shapley(nodes, x)[0], shares, atol=1e-12)


def test_deep_trees_in_seconds():
    rng = np.random.default_rng(1)
    nodes, x = grown(rng, 15, 10, 200, 0.97), rng.normal(size=(10_000, 10))
    start = time.time()
    assert len(nodes.predict(x)) == 10_000
    got, base = trees.shapley(nodes, x[:20])
    np.testing.assert_allclose(got.sum(axis=1) + base, nodes.predict(x[:20]), atol=1e-8)
    print(len(nodes.value), time.time() - start)
    assert time.time() - start < 60
