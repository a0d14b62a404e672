import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import best_fit, bin_slack
from tests.llm.support import SCHEMA, odd_documents, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_places_of_all_pieces(spark, capacity):
    rows = odd_rows()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for n, lo in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[lo : lo + capacity], "<u4")
            want.append((r[0], n, lo, len(own), zlib.crc32(own.tobytes())))
    found = bin_slack.pack(odd_documents(spark), PATH, capacity=capacity).collect()
    plain = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(plain(r[:5]) for r in found) == sorted(map(plain, want))
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // capacity) + 2


def test_plan_is_gapless_and_fits():
    rng = random.Random(4)
    for _ in range(20):
        capacity = rng.choice([10, 50, 200])
        counts = {}
        for _ in range(rng.randrange(1, 300)):
            n = min(capacity, int(rng.expovariate(4 / capacity)) + 1)
            counts[n] = counts.get(n, 0) + 1
        rows = bin_slack.plan(counts, capacity)
        for length, n in counts.items():
            own = sorted((r[1], r[2]) for r in rows if r[0] == length)
            assert sum(m for _, m in own) == n and [a for a, _ in own] == [sum(m for _, m in own[:i]) for i in range(len(own))]
        fill = {}
        for length, _, pieces, per, first, _ in rows:
            for b in range(first, first + pieces // per):
                fill[b] = fill.get(b, 0) + per * length
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
    assert bin_slack.plan({}, 10) == []


def test_fullest_is_the_best_of_all_subsets():
    rng = random.Random(6)
    for _ in range(60):
        capacity = 40
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        counts = {n: items.count(n) for n in items}
        got = bin_slack.fullest(dict(counts), capacity)
        assert all(got[n] <= counts[n] for n in got) and max(items) in got
        rest = sorted(items)[:-1]
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums if s + n + max(items) <= capacity}
        assert sum(n * m for n, m in got.items()) == max(items) + max(sums)


def test_rows_of_ids_give_the_documents_back(spark):
    rows = odd_rows()
    for window in (500, best_fit.WINDOW):
        found = best_fit.pack_ids(odd_documents(spark), PATH, capacity=128, window=window).collect()
        parts = {}
        for r in found:
            ids = np.frombuffer(r.ids, "<u2")
            assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 128 and r.cu_seqlens[0] == 0
            assert r.position_starts == r.doc_starts
            for i, (doc, start) in enumerate(zip(r.doc_ids, r.doc_starts)):
                parts.setdefault(doc, []).append((start, ids[r.cu_seqlens[i] : r.cu_seqlens[i + 1]].tolist()))
        assert len({r.sequence_id for r in found}) == len(found)
        repeated = [r[0] for r in rows if [x[0] for x in rows].count(r[0]) > 1]
        for r in rows:
            if r[0] not in repeated:
                assert [i for _, part in sorted(parts[r[0]]) for i in part] == ids_of(r[1])
        total = sum(len(ids_of(r[1])) for r in rows)
        assert sum(r.n_tokens for r in found) == total


def test_best_fit_takes_the_fullest_row():
    rng = random.Random(8)
    lengths = np.array([rng.randrange(1, 33) for _ in range(400)])
    rows = best_fit.best_fit(lengths, 32)
    # The same by looking at all rows.
    free, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(32 - lengths[i])
    want = sorted(free)
    assert sorted(32 - sum(int(lengths[i]) for i in row) for row in rows) == want


def test_too_large_ids_are_refused(spark):
    with pytest.raises(Exception, match="do not fit"):
        best_fit.pack_ids(odd_documents(spark), PATH, bits=32).count()
        best_fit.pack_ids(odd_documents(spark, [(1, "x", None, None, None, None, None, None)]), PATH, end=70_000).count()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bin_slack.pack(empty, PATH).collect() == [] and best_fit.pack_ids(empty, PATH).collect() == []
