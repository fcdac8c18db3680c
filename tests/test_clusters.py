"""DBSCAN clusters in several dimensions against brute force."""

import numpy as np
import pytest

from chronopanel.operators import clusters

import __spark_entry__  # noqa: F401  functions travel by value


def brute(m, eps, least=5):
    """core, noise and cluster (by the least core point) of each row."""
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.arange(len(m))
    while True:
        new = np.array([label[near[i] & core].min() if core[i] else label[i] for i in range(len(m))])
        if (new == label).all():
            break
        label = new
    roots = {label[i] for i in np.flatnonzero(core)}
    order = sorted(roots, key=lambda r: min(tuple(m[i]) for i in np.flatnonzero(core & (label == r))))
    rank = {r: k for k, r in enumerate(order)}
    touch = [sorted({rank[label[j]] for j in np.flatnonzero(near[i] & core)}) for i in range(len(m))]
    return core, ~(near & core[None]).any(1), [t[0] if t else None for t in touch]


def rings(rng):
    """Two rings inside each other, blobs, a thin bridge, copies and stray points."""
    a = rng.uniform(0, 2 * np.pi, 240)
    ring = np.column_stack([np.cos(a), np.sin(a)]) * np.where(np.arange(240) % 2, 6, 3)[:, None] + rng.normal(0, 0.15, (240, 2))
    bridge = np.column_stack([np.linspace(3, 6, 14), np.zeros(14)])
    blobs = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((12, 12), (-12, 9), (12, -12))])
    return np.round(np.concatenate([ring, blobs, bridge, np.full((30, 2), 20.0), [[30, 30], [-30, 1]]]), 2)


@pytest.mark.parametrize("eps,dims,bridge", [(0.15, 2, True), (0.1, 2, False), (0.25, 3, False)])
def test_clusters(panel_of, eps, dims, bridge):
    rng = np.random.default_rng(9)
    m = rings(rng)
    if not bridge:
        m = np.delete(m, np.arange(420, 434), axis=0)
    x = np.column_stack([m, np.round(rng.normal(0, 1, len(m)), 1)])[:, :dims]
    p = panel_of({"a": x[:, 0], "b": x[:100, 0]}, features={f"f{i}": {"a": x[:, i], "b": x[:100, i]} for i in range(1, dims)})
    got = clusters.cluster_points(p, eps=eps).toPandas()
    for k, v in (("a", x), ("b", x[:100])):
        core, noise, cluster = brute(v / v.std(axis=0), eps)
        g = got[got["k"] == k].set_index(["y", *[f"f{i}" for i in range(1, dims)]])
        assert len(g) == len({tuple(r) for r in v}) and g["c"].sum() == len(v)
        for row, c, z, label in zip(map(tuple, v), core, noise, cluster):
            r = g.loc[row]
            assert (r["core"], r["noise"]) == (c, z) and (label is None) == bool(np.isnan(r["cluster"])) and (label is None or r["cluster"] == label)


def test_cutting_goes_on_until_points_decide(panel_of, monkeypatch):
    """Boxes cut in two and early comparison of points give the same clusters."""
    rng = np.random.default_rng(11)
    x = np.round(np.column_stack([rng.uniform(0, 6, 400), rng.uniform(0, 6, 400)]), 3)
    p = panel_of({"a": x[:, 0]}, features={"f": {"a": x[:, 1]}})
    want = brute(x / x.std(axis=0), 0.12)
    for cut, levels in ((4, 6), (2, 1)):
        monkeypatch.setattr(clusters, "CUT", cut)
        monkeypatch.setattr(clusters, "LEVELS", levels)
        s = clusters.cluster_summary(p, eps=0.12).first()
        assert (s["n_core"], s["n_noise"], s["n_clusters"]) == (want[0].sum(), want[1].sum(), len({c for c in want[2] if c is not None}))
