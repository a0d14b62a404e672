from collections import Counter, defaultdict

import pytest

from corvane.llm import mixing
from tests.llm.support import SCHEMA, odd_documents, odd_rows, words


def want_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while len(full) < len(names):
        share = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and weight[s] * share > 3 * sizes[s]}
        if not new:
            break
        full |= new
    return {s: 3.0 * sizes[s] if s in full else weight[s] * share for s in names}


def check(found, read, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = want_targets(sizes)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"]) for r in found) == sorted((-1 if r[0] is None else r[0], len(words(r[1]))) for r in rows)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)
    # Each document is read front to back, without gaps or repeats, once for each epoch.
    spans = defaultdict(list)
    for r in read:
        spans[r.rk, r.copy, r.epoch].append((r.begin, r.end))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_sources_give_their_targets(spark):
    docs = odd_documents(spark)
    found, read = mixing.mix(docs)
    again = mixing.mix(docs.repartition(5))[0]
    keys = ("doc_id", "rk", "copy", "taken")
    first = found.collect()
    check(first, read.collect(), odd_rows())
    assert sorted(str([r[k] for k in keys]) for r in first) == sorted(str([r[k] for k in keys]) for r in again.collect())


def test_hot_and_tiny_sources_are_spread_evenly(spark):
    rows = [(i, "w " * (i % 40 + 1), "en", "hot", 0, "", "", 0) for i in range(600)]
    rows += [(1000 + i, "w " * 30, "en", f"s{i % 9}", 0, "", "", 0) for i in range(90)] + [(5000, "just three words", "en", "tiny", 0, "", "", 0)]
    found, read = mixing.mix(odd_documents(spark, rows))
    check(found.collect(), read := read.collect(), rows)
    # Every tenth of the schedule holds about a tenth of the hot source.
    slots = sorted((r.slot, r.end - r.begin) for r in read if r.doc_id < 1000)
    last = max(r.slot for r in read)
    parts = Counter()
    for slot, n in slots:
        parts[10 * slot // (last + 1)] += n
    total = sum(parts.values())
    assert all(abs(parts[i] / total - 0.1) < 0.03 for i in range(9))


def test_mixed_documents_and_empty_tables(spark):
    docs = odd_documents(spark)
    taken = {(r.doc_id, r.rk, r["copy"]): r.taken for r in mixing.mix(docs)[0].collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert sum(len(words(r.text)) for r in got) == sum(taken.values())
    whole = {r[1] for r in odd_rows()}
    assert sum(r.text in whole for r in got) > len(got) / 2 and all(r.n_chars == len(r.text) for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty)[0].collect() == [] and mixing.mixed_documents(empty).collect() == []
    blank = odd_documents(spark, [(1, None, None, None, None, None, None, None), (2, " ", None, "a", 1, None, None, None)])
    assert sorted(r.taken for r in mixing.mix(blank)[0].collect()) == [0, 0]


def unit_of(slot, total):
    """The unit that the golden-ratio point of a slot falls into, in whole numbers."""
    return slot * 679_535_556_991 % (1 << 40) * total // (1 << 40)


def test_schedule_is_that_of_the_golden_ratio(spark):
    """Slots are drawn by the points alone: another multiplier gives other slots, and every stretch of the schedule
    holds the sources in the proportions of the whole."""
    rows = [(i, "w " * 40, "en", f"s{i % 3}", 0, "", "", 0) for i in range(300)]
    found, read = mixing.mix(odd_documents(spark, rows))
    sources = mixing.targets(mixing.sized(odd_documents(spark, rows)))
    drawn = sorted((r.slot, r.sid, r["rank"]) for r in mixing.slots(sources).collect())
    goals = {r.sid: round(r.target) for r in sources.collect()}
    blocks = {s: -(-g // min(mixing.BLOCK, -(-g // mixing.LEAST_BLOCKS))) for s, g in goals.items()}
    total, want, ranks = sum(blocks.values()), [], Counter()
    owner = [s for s in sorted(blocks) for _ in range(blocks[s])]
    for slot in range(2 * total):
        sid = owner[unit_of(slot, total)]
        if ranks[sid] < blocks[sid]:
            want.append((slot, sid, ranks[sid]))
        ranks[sid] += 1
    assert drawn == want and len(drawn) == total
    # The first n slots hold each source n * share times, give or take three.
    count = Counter()
    for n, (_, sid, _) in enumerate(drawn[: total // 2], 1):
        count[sid] += 1
        assert all(abs(count[s] - n * blocks[s] / total) < 3 for s in blocks)
    # The documents' places in the mix are those of the slots that read them.
    places = defaultdict(list)
    for r in read.collect():
        places[r.rk, r.copy].append(r.slot)
    for r in found.collect():
        own = places[r.rk, r["copy"]]
        assert (r.first_slot, r.last_slot, r.reads) == (min(own, default=None), max(own, default=None), len(own))
