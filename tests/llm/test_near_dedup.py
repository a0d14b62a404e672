import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import near_dedup
from corvane.llm.components import connected
from tests.llm.support import SCHEMA, odd_documents, odd_rows, words


def brute(rows, k, percent):
    sets = {}
    for i, r in enumerate(rows):
        w = words(r[1], lower=True)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 80)])
def test_components_are_those_of_all_pairs(spark, k, percent):
    rows = odd_rows()
    found = near_dedup.near_duplicates(odd_documents(spark), k=k, percent=percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=key) == sorted(brute(rows, k, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Many copies of few edits: links are found through several pieces and tiles of the buckets."""
    monkeypatch.setattr(near_dedup, "PIECE", 16)
    monkeypatch.setattr(near_dedup, "TILE", 32)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        rows.append((1000 - i, " ".join(w), "en", "s", 0, "", "", 0))
    rows += [(2000 + i, " ".join([*base[:60], *[f"own{i}x{j}" for j in range(60)]]), "en", "s", 0, "", "", 0) for i in range(60)]
    found = near_dedup.near_duplicates(odd_documents(spark, rows), k=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(rows, 4, 80))


def test_links_beyond_the_signature_distance(spark):
    """Of many pairs at a similarity of exactly 0.8, a few differ in more than 15 of 32 positions; a shared key finds them."""
    rows = []
    for i in range(30_000):
        w = [f"p{i}x{j}" for j in range(10)]
        rows += [(2 * i, " ".join(w[:9]), "", "", 0, "", "", 0), (2 * i + 1, " ".join(w[1:]), "", "", 0, "", "", 0)]
    found = near_dedup.near_duplicates(odd_documents(spark, rows), k=1).collect()
    assert [r.doc_id for r in found if r.component_id != r.doc_id // 2 * 2] == []


@pytest.mark.parametrize("step", ["central_pairs", "foreign_pairs", "crossing_pairs"])
def test_work_grows_with_the_buckets_not_their_square(spark, monkeypatch, step):
    """A task that holds four times as many small buckets makes at most about four times as many calls."""
    chunks = {f"c{i}": "long" for i in range(8)}
    kinds = {"key": "long", "slot": "int", "cid": "long", "m": "long", "n": "int", "s": "long", "bits": "binary", **chunks}
    members = spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    labels = spark.createDataFrame([], "cid long, label long")
    runs = []
    monkeypatch.setattr(type(members), "mapInArrow", lambda self, f, schema: runs.append(f) or self)
    getattr(near_dedup, step)(members, *[labels] * (step != "central_pairs"), 80)

    def work(buckets):
        cid = np.arange(2 * buckets)
        cols = {c: cid // 2 for c in ("key", *chunks)} | dict.fromkeys(("part", "t", "u", "tile", "slot"), cid * 0) | {"cid": cid, "label": cid}
        cols |= {"n": np.full(len(cid), 100), "s": np.full(len(cid), 100), "bits": [bytes(near_dedup.PARITY // 8)] * len(cid)}
        batches = pa.table(cols).to_batches(max_chunksize=999)
        calls = 0

        def count(frame, event, arg):
            nonlocal calls
            calls += event == "call"

        sys.setprofile(count)
        try:
            found = [b.to_pydict() for b in runs[0](iter(batches))]
        finally:
            sys.setprofile(None)
        assert {x for b in found for x in zip(b["a"], b["b"])} == {(i, i + 1) for i in range(0, 2 * buckets, 2)}
        return calls

    assert work(2000) < 6 * work(500)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_connected(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        top[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.cid, r.label) for r in found) == sorted((x, find(x)) for x in linked)
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
