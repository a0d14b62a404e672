import math

import numpy as np
import pytest

from corvane.llm import metric_join as mj

SCHEMA = "vec_id long, embedding array<float>, label int, v int, node string"


def exact(rows, least=0.9):
    """Links, components and kept rows by comparing all pairs."""
    good = []
    for at, (_, v, *_) in enumerate(rows):
        if v and None not in v:
            x = np.array(v, np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                good.append((at, x / np.abs(x).max()))
    peers = {at: set() for at, _ in good}
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                peers[a].add(b)
                peers[b].add(a)
    out = []
    for at, row in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            for b in peers.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((row[0], len(peers.get(at, ())), low, row[0] is not None and row[0] == low))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def vectors(seed=1, n=600, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dims))
    x = np.concatenate([centres[rng.integers(25, size=n)] + 0.25 * rng.normal(size=(n, dims)), centres[0] + 0.02 * rng.normal(size=(200, dims))])
    rows = [(i * 3, [float(a) for a in np.float32(v)], 0, 1, "x") for i, v in enumerate(x)]
    rows += [(10_000 + i, rows[5][1], 0, None, None) for i in range(150)]
    rows += [(20_000 + i, [2 * a for a in rows[7][1]], 0, 1, "") for i in range(2)]
    rows += [(30_000, None, 0, 1, ""), (30_001, [], 0, 1, ""), (30_002, [0.0] * dims, 0, 1, ""), (30_003, [float("nan")] + [1.0] * (dims - 1), 0, 1, "")]
    rows += [(30_004, [None] + [1.0] * (dims - 1), 0, 1, ""), (30_005, [float("inf")] * dims, 0, 1, ""), (30_006, [1.0] * 3, 0, 1, "")]
    rows += [(None, rows[9][1], 0, 1, ""), (None, None, 0, 1, ""), rows[4], (30_007, [3e38] * dims, 0, 1, ""), (30_008, [1e-40] * dims, 0, 1, "")]
    return rows


@pytest.mark.parametrize("least", [0.9, 0.5, 0.99])
def test_links_are_those_of_all_pairs(spark, least):
    rows = vectors()
    found = mj.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(exact(rows, least), key=key)


@pytest.mark.parametrize("pivots", [1, 7, 64])
def test_any_number_of_pivots_and_tiles_gives_the_same(spark, monkeypatch, pivots):
    monkeypatch.setattr(mj, "TILE", 8 * 30)
    monkeypatch.setattr(mj, "STRIP", 7)
    monkeypatch.setattr(mj, "choose", lambda sample, total, eps: mj.Pivots(sample[:pivots], eps))
    rows = vectors(2, 300)
    found = mj.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(exact(rows), key=key)


def test_each_pair_within_reach_meets_in_one_cell_only():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    eps = math.sqrt(0.2)
    home, core, copies = mj.Pivots(x[:40], eps).place(x)
    near = x @ x.T >= 0.9
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        cells = {home[a]} & {home[b]} | ({home[a]} if copies[b, home[a]] else set()) | ({home[b]} if copies[a, home[b]] else set())
        assert len(cells) == 1
    for c in range(40):
        inside = np.flatnonzero(core & (home == c))
        assert near[np.ix_(inside, inside)].all()
    # Cells spare most of the pairs of such vectors.
    own, extra = np.bincount(home, minlength=40), copies.sum(axis=0)
    assert (own * (own - 1) // 2 + own * extra).sum() < 0.5 * 800 * 799 / 2


def test_clusters_are_parted_and_even_vectors_are_not():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 64))
    tight = centres[rng.integers(300, size=4000)] + 0.1 * rng.normal(size=(4000, 64))
    even = rng.normal(size=(4000, 64))
    eps = math.sqrt(0.2)
    shares = []
    for x in (tight, even):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        pivots = mj.choose(x, 1_000_000, eps)
        home, core, copies = pivots.place(x)
        own, cores = np.bincount(home), np.bincount(home[core], minlength=home.max() + 1)
        shares.append(((own**2 - cores**2) / 2 + own * copies.sum(axis=0)[: len(own)]).sum() / (len(x) ** 2 / 2))
    assert shares[0] < 0.05 and shares[1] > 0.9


def test_spanning_links_join_the_same():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
        x, y = mj._spanning(a, b, 60)
        label = {}
        for u, v in ((a, b), (x, y)):
            group = list(range(60))
            for _ in range(60):
                for i, j in zip(u, v):
                    group[i] = group[j] = min(group[i], group[j])
            label[id(u)] = group
        assert label[id(a)] == label[id(x)] and len(x) < 60


def test_empty_tables(spark):
    assert mj.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(3, None, 0, 0, "")], SCHEMA)
    assert [tuple(r) for r in mj.near_duplicates(none).collect()] == [(3, 0, 3, True)]
    doubles = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e-200, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in mj.near_duplicates(doubles).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
