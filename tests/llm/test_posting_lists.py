import numpy as np
import pytest

from corvane.llm import posting_lists as pl

SCHEMA = "vec_id long, embedding array<float>, label int, v int, list string"


def exact(rows, k, every):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 8 and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def vectors(n=1500, copies=300, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(12, size=n)] + 0.4 * rng.normal(size=(n, 8))
    rows = [(i, [float(a) for a in np.float32(v)], 0, 1, "x") for i, v in enumerate(x)]
    rows += [(10_000 + i, rows[5][1], 0, None, None) for i in range(copies)]
    rows += [(20_000, None, 0, 1, ""), (20_010, [], 0, 1, ""), (20_020, [0.0] * 8, 0, 1, ""), (20_030, [float("nan")] + [1.0] * 7, 0, 1, "")]
    rows += [(20_040, [None] + [1.0] * 7, 0, 1, ""), (20_050, [float("inf")] + [1.0] * 7, 0, 1, ""), (20_060, [1.0] * 3, 0, 1, ""), (None, [1.0] * 8, 0, 1, "")]
    return rows


def test_recall_order_and_ties(spark, monkeypatch):
    monkeypatch.setattr(pl, "LIST_SIZE", 32)
    monkeypatch.setattr(pl, "PART", 40)
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA)
    want = exact(rows, 10, 10)
    found = {}
    for r in pl.nearest(table, table.filter("vec_id % 10 = 0"), k=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == want.keys()
    hits = 0
    for q, own in found.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        scores = dict((i, d) for i, d in exact_of(rows, q).items())
        for _, i, d in own:
            assert d == pytest.approx(scores[i], abs=1e-12)
        assert own == sorted(own, key=lambda t: (t[2], t[1])) and q not in {i for _, i, _ in own}
        hits += len({i for _, i, _ in own} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    # Copies of one vector: the ten smallest other ids.
    assert [i for _, i, _ in found[10_010]] == [5, *range(10_000, 10_009)]


def exact_of(rows, q):
    good = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v is not None and len(v) == 8 and None not in v}
    return {i: float(np.sqrt(((v - good[q]) ** 2).sum())) for i, v in good.items()}


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0] * 8, 0, 0, ""), (100, [2.0] * 8, 0, 0, ""), (7, [1.0] * 8, 0, 0, ""), (7, [1.0] * 8, 0, 0, "")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = sorted(tuple(r) for r in pl.nearest(table, table.filter("vec_id % 100 = 0")).collect())
    assert [(q, r, i) for q, r, i, _ in found] == [(0, 1, 7), (0, 2, 100), (100, 1, 0), (100, 2, 7)]
    for none in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(0, None, 0, 0, "")], SCHEMA)):
        assert pl.nearest(none, none).collect() == []


def test_graph_walk_finds_the_lists_within_the_ratio():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 6))
    order = np.argsort(((c[:, None] - c) ** 2).sum(-1), axis=1)
    index = pl.Index(c, np.concatenate([order[:, 1:25], (np.arange(300)[:, None] + 1) % 300], axis=1), 1.4)
    found = wanted = 0
    for q in rng.normal(size=(100, 6)):
        d = np.sqrt(((c - q) ** 2).sum(axis=1))
        want = set(np.flatnonzero(d <= 1.4 * d.min()).tolist())
        found += len(want & set(index.near(q).tolist()))
        wanted += len(want)
    assert found >= 0.98 * wanted


def test_isolated_clusters_have_all_their_neighbours(spark, monkeypatch):
    """A query in a cluster of few vectors, or alone at its centroid, still has ten neighbours."""
    monkeypatch.setattr(pl, "LIST_SIZE", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 8))
    rows = [(i + 1000, [float(a) for a in np.float32(v)], 0, 1, "x") for i, v in enumerate(x)]
    rows += [(i, [50.0 + 0.01 * i] * 8, 0, 1, "") for i in range(4)] + [(10, [-80.0] * 8, 0, 1, "")]
    table = spark.createDataFrame(rows, SCHEMA)
    c = np.concatenate([x[:30], [[50.0] * 8], [[-80.0] * 8]])
    order = np.argsort(((c[:, None] - c) ** 2).sum(-1), axis=1)
    index = pl.Index(c, np.concatenate([order[:, 1:9], (np.arange(32)[:, None] + 1) % 32], axis=1), 1.2)
    found: dict = {}
    for r in pl.nearest(table, table.filter("vec_id < 1000"), k=10, index=index).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert found.keys() == {0, 1, 2, 3, 10} and all([r for r, _ in sorted(own)] == list(range(1, 11)) for own in found.values())
    assert all({i for _, i in sorted(found[q])[:3]} == {0, 1, 2, 3} - {q} for q in range(4))


@pytest.mark.parametrize("scale", [1.0, 1e-18])
def test_recall_in_clusters_far_apart(spark, monkeypatch, scale):
    """Lists within the ratio lie in one cluster, and the walk over the centroids has to get there first."""
    monkeypatch.setattr(pl, "LIST_SIZE", 16)
    rng = np.random.default_rng(1)
    x = scale * (rng.normal(size=(40, 8))[rng.integers(40, size=4000)] + 0.1 * rng.normal(size=(4000, 8)))
    rows = [(i, [float(a) for a in np.float32(v)], 0, 1, "x") for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = exact(rows, 10, 20)
    found = {(r.query_id, r.vec_id) for r in pl.nearest(table, table.filter("vec_id % 20 = 0"), k=10).collect()}
    assert len(found) == 10 * len(want)
    assert len(found & {(q, i) for q, own in want.items() for i, _ in own}) >= 0.95 * len(found)
