import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import bloom_lm
from tests.llm.support import SCHEMA, odd_documents, odd_rows, words


@pytest.mark.parametrize("block,shard", [(8 << 20, 12 << 20), (4000, 3000)])
def test_scores_are_those_of_exact_counts(spark, monkeypatch, block, shard):
    monkeypatch.setattr(bloom_lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(bloom_lm, "SHARD_BYTES", shard)
    rows = odd_rows()
    single, pairs, texts = Counter(), Counter(), []
    for r in rows:
        w = [*words(r[1], lower=True), "\0"]
        held = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0
        texts.append((r[0], held, w))
        if not held:
            single.update(w)
            pairs.update(zip(["\1", *w], w))
    n, v = sum(single.values()), len(single)
    middle = lambda c: (3 * 2 ** math.floor(math.log2(c)) - 1) / 2 if c else 0
    want = []
    for doc, held, w in texts:
        base = sum(math.log10((single[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        model = 0.0
        for a, x in zip(["\1", *w], w):
            context = middle(single["\0" if a == "\1" else a])
            p = (min(middle(pairs[a, x]), context) + bloom_lm.MU * (middle(single[x]) + 0.1) / (n + 0.1 * (v + 1))) / (context + bloom_lm.MU)
            model += math.log10(p)
        want.append((-1 if doc is None else doc, held, len(w), sum(single[x] > 0 for x in w), n, base, model))
    found = [(-1 if r[0] is None else r[0], *r[1:]) for r in bloom_lm.score(odd_documents(spark)).collect()]
    off = []
    for got, exp in zip(sorted(found), sorted(want), strict=True):
        assert got[:5] == exp[:5] and got[5] == pytest.approx(exp[5], abs=1e-6)
        off.append((got[6] - exp[6]) / exp[2])
    # False positives of the filter raise a few counts.
    assert np.mean(np.abs(off)) < 0.05


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    counts = rng.geometric(0.3, 5000) ** 3
    data, size = bloom_lm._shard_filter(bloom_lm._key(h, 0), counts, 1 << 40)
    model = bloom_lm.LogFilter(0, np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([size]))
    level = np.floor(np.log2(counts))
    exact = (3 * 2.0**level - 1) / 2
    got = model.counts(h)
    assert (got >= exact).all() and (got == exact).mean() > 0.95
    strange = model.counts(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (strange == 0).mean() > 0.95
    # Under a bound, the rarest go first.
    _, small = bloom_lm._shard_filter(bloom_lm._key(h, 0), counts, size // 3)
    assert 0 < small <= size // 3


def test_no_rows_and_no_training_rows(spark):
    assert bloom_lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = bloom_lm.score(odd_documents(spark, [(held, "two words", None, None, None, None, None, None)])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, pytest.approx(0))


def test_held_out_texts_score_higher_than_shuffled_ones(spark):
    rng = random.Random(2)
    order = {f"w{i}": f"w{(7 * i + 1) % 50}" for i in range(50)}
    rows = []
    for i in range(200):
        w = [f"w{rng.randrange(50)}"]
        for _ in range(60):
            w.append(order[w[-1]] if rng.random() < 0.9 else f"w{rng.randrange(50)}")
        rows.append((i, " ".join(w), None, None, None, None, None, None))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10 == 0]
    shuffled = []
    for r in held:
        w = r[1].split()
        rng.shuffle(w)
        shuffled.append((r[0], " ".join(w), None, None, None, None, None, None))
    train = [r for r in rows if r not in held]
    good, bad = (np.mean([r.score / r.n_tokens for r in bloom_lm.score(odd_documents(spark, train + x)).collect() if r.held_out]) for x in (held, shuffled))
    assert good > bad + 0.3


@pytest.mark.parametrize("shard", [12 << 20, 8000])
def test_rare_bigrams_stay_however_large_the_filter(spark, monkeypatch, shard):
    """A filter bound far below the corpus, where an older version had one, costs no n-gram and no word its count."""
    monkeypatch.setattr(bloom_lm, "MOST_BYTES", 1024, raising=False)
    monkeypatch.setattr(bloom_lm, "SHARD_BYTES", shard)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)), None, None, None, None, None, None) for i in range(200)]
    found = bloom_lm.score(odd_documents(spark, rows)).collect()
    # Every bigram of a training row occurs once, after a word that occurs once: it gets half of its count at least, not p(w).
    inner = [r for r in found if not r.held_out]
    assert inner and all(r.score / r.n_tokens > math.log10(1 / 3) - 0.1 for r in inner)
