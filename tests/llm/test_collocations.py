import random
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import collocations as co
from tests.llm.support import LOWER, SCHEMA, odd_documents, odd_rows

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counts(rows):
    f, n = {}, Counter()
    for r in rows:
        own = f.setdefault(r[2] or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (r[1] or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[r[2] or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f, n


def best(rows, support=30, percent=80, most=2000):
    f, n = counts(rows)
    out = []
    for lang, own in f.items():
        able = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        inside = set()
        for p, a in able.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= percent * own[p[i : i + m]]:
                        inside.add(p[i : i + m])
        found = []
        for p, a in able.items():
            if p not in inside:
                score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), l, r))
        for i, (s, a, _, p, l, r) in enumerate(sorted(found)[:most]):
            out.append((lang, i + 1, p, -a, l, r, n[lang], -s))
    return out


def texts(seed=1, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "漢字", "a\xa0b"]
    fixed = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words).upper())
            parts.append(rng.choice([" ", " ", "\t ", ", ", ".", "\n", " ; "]))
        rows.append((i, "".join(parts), ["en", "de", None][i % 3], "s", 1, "", "", 1))
    return rows + rows[:9] + [rows[0]] * 40


@pytest.mark.parametrize("every", [1, 4, 24, 1000])
def test_dictionary_counts_every_phrase_once(spark, monkeypatch, every):
    monkeypatch.setattr(co, "EVERY", every)
    rows = texts()[:50] + odd_rows()
    f: dict = {}
    for r in co.dictionary(odd_documents(spark, rows)).collect():
        pieces, at = r.chunk.split("\n"), 0
        for piece in pieces:
            w = piece.split(" ")
            for i in range(len(w)):
                if at + i < r.owned:
                    for k in range(1, 5):
                        if i + k <= len(w):
                            f.setdefault(r.lang, Counter())[tuple(w[i : i + k])] += r.n
            at += len(w)
    want, _ = counts(rows)
    assert f == {lang: c for lang, c in want.items() if c}


@pytest.mark.parametrize("block,shard,every", [(1 << 20, 1 << 21, 24), (300, 200, 4)])
def test_phrases_are_those_of_a_plain_loop(spark, monkeypatch, block, shard, every):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("EVERY", every)):
        monkeypatch.setattr(co, name, value)
    for rows, support, percent, most in ((texts(), 30, 80, 2000), (odd_rows() + texts(2, 20), 3, 60, 40)):
        found = co.collocations(odd_documents(spark, rows), support=support, percent=percent, most=most).select(*COLUMNS)
        want = best(rows, support, percent, most)
        assert len(want) > 20 and sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_counts_of_hot_and_long_texts(spark):
    rows = [(1, "a " * 5000, None, "s", 1, "", "", 1)] + [(i, "new york city. " * 3, "en", "s", 1, "", "", 1) for i in range(2, 100)]
    found = sorted(tuple(r) for r in co.collocations(odd_documents(spark, rows)).select(*COLUMNS).collect())
    assert found == sorted(best(rows))


def test_asked_counts_are_capped_at_the_support_only():
    asked = co._asked(7, np.array([5, 1, 1, (1 << 32) + 2], np.uint64), np.array([300, 1, 2, 0]), 30)
    assert asked.column("shard").to_pylist() == [0, 1] and asked.column("counts").to_pylist() == [bytes([3, 30]), bytes([0])]
    answer = co._answers(30)(asked.slice(0, 1))
    assert np.frombuffer(answer.column("names")[0].as_py(), np.uint64).tolist() == [5]


def test_empty_tables(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, " .,\n", "en", None, None, None, None, None)], SCHEMA)
    assert co.collocations(none).collect() == []
