import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from corvane.llm import resampling as rs
from tests.llm.support import LOWER, SCHEMA, odd_documents, odd_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def drawn(rows, target, buckets=10_000, longest=1, least=20, percent=10):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(at, runs(r[1], longest)[1]))
    for text in target:
        t.update(map(at, runs(text, longest)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for r in rows:
        w, f = runs(r[1], longest)
        weight = sum(gain[at(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(f), weight, score, len(w)])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    ranks = {id(x): i + 1 for i, x in enumerate(able[: len(able) * percent // 100])}
    return [(*x[:4], ranks.get(id(x))) for x in out]


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 97, 50), (1, 10_000, 100)])
def test_draw_is_that_of_a_plain_loop(spark, longest, buckets, percent):
    rows = odd_rows()
    target = [rows[9][1], rows[30][1], None, "", "Été 漢字 word1"]
    docs = odd_documents(spark, rows)
    texts = spark.createDataFrame([(i, t, "s") for i, t in enumerate(target)], "item_id int, text string, weight string")
    found = as_rows(rs.resample(docs, texts, buckets=buckets, longest=longest, percent=percent))
    assert sorted(found, key=key) == sorted(drawn(rows, target, buckets, longest, 20, percent), key=key)


def test_repeated_rows_and_ties_are_cut_at_the_right_place(spark):
    """A third of the table is one row, and the cut falls inside it."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(25)), "en", "s", 1, "", "", 1) for i in range(200)]
    best = max(drawn(rows, ["w1 w2"], percent=0), key=lambda r: r[3])
    rows += [rows[best[0]]] * 100
    found = as_rows(rs.resample(odd_documents(spark, rows), spark.createDataFrame([("w1 w2",)], "text string"), percent=20))
    assert sorted(found, key=key) == sorted(drawn(rows, ["w1 w2"], percent=20), key=key)
    assert sorted(r[4] for r in found if r[4] is not None) == list(range(1, 61))


def test_quickselect_finds_every_place(spark, monkeypatch):
    monkeypatch.setattr(rs, "PIVOTS", 3)
    rng = random.Random(2)
    values = [(rng.randrange(5), i) for i in range(60)]
    keys = spark.createDataFrame(values, "a long, b long").repartition(4)
    for k in (1, 2, 17, 59, 60):
        assert rs.kth_key(keys, ["a", "b"], k) == sorted(values)[k - 1]
    with pytest.raises(ValueError):
        rs.kth_key(keys, ["a", "b"], 61)


def test_empty_tables_and_too_few_words(spark):
    empty, text = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("one two",)], "text string")
    assert as_rows(rs.resample(empty, text)) == []
    few = spark.createDataFrame([(1, "one two", None, None, None, None, None, None), (2, None, None, None, None, None, None, None)], SCHEMA)
    for target in (text, text.limit(0)):
        assert [r[4] for r in as_rows(rs.resample(few, target, percent=100))] == [None, None]
