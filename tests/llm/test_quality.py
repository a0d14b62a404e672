import math
import random
from collections import Counter

import pytest

from corvane.llm import risk_rules, site_quality
from tests.llm.support import SCHEMA, labels, odd_documents, odd_rows, prose, words


def corpus(seed=1, n=900):
    """Good and bad documents; on one host nearly all are bad."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        host = f"h{i % 6}"
        bad = rng.random() < (0.9 if host == "h3" else 0.1)
        text = prose(rng, rng.randrange(30, 120))
        if bad:
            text = text.upper() + " !!! $$$ &&&" * rng.randrange(3, 20)
        rows.append((i, text, "en", host, len(text), "", "", 0))
        truth[i] = int(not bad)
    return rows, truth


def test_sites_shrink_towards_their_hosts(spark):
    rows, truth = corpus()
    # An undecidable document on a bad and on a good host, and a host of its own.
    text = "some plain words $$$ HERE!"
    rows += [(5000 + i, text, lang, host, 0, "", "", 0) for i, (lang, host) in enumerate([("en", "h3"), ("en", "h0"), ("xx", "h3"), ("en", "new")])]
    known = labels(spark, [(i, y, 0) for i, y in truth.items() if i % 2])
    found = {r.doc_id: r for r in site_quality.classify(odd_documents(spark, rows), known).collect()}
    right = sum(found[i].kept == bool(y) for i, y in truth.items())
    assert right >= 0.98 * len(truth)
    bad, good, path, new = (found[5000 + i] for i in range(4))
    assert bad.evidence == pytest.approx(good.evidence) and bad.p_quality < new.p_quality < good.p_quality
    # A path without other documents takes its host's rate, a host without others the global one.
    assert path.path_rate == pytest.approx(path.host_rate, abs=0.02)
    rate = sum(truth.values()) / len(truth)
    assert new.path_rate == pytest.approx(rate, abs=0.05) and bad.path_rate < 0.25


def test_quality_of_odd_rows(spark):
    rows = odd_rows()
    found = site_quality.classify(odd_documents(spark), labels(spark)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert all(0 <= r.p_quality <= 1 and r.kept is not None for r in found)
    none = site_quality.classify(odd_documents(spark), labels(spark, [])).collect()
    assert len(none) == len(rows) and all(r.kept for r in none)
    assert site_quality.classify(spark.createDataFrame([], SCHEMA), labels(spark)).collect() == []


def test_counts_are_those_of_plain_loops(spark):
    rows = odd_rows() + [(900 + i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(["a b c d e " * 4, "l one\nl one\n\n \nl two\nl one", "#|x <b> a\n#|x <b> a\r"])]
    want = []
    for r in rows:
        w, text = words(r[1]), r[1] or ""
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if times[x] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((r[0] if r[0] is not None else -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed))
    found = risk_rules.judge(odd_documents(spark, rows), labels(spark)).collect()
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id if r.doc_id is not None else -1, *[r[k] for k in keys]) for r in found) == sorted(want)
    assert not any(r.kept and r.base_failed for r in found)
    assert risk_rules.judge(spark.createDataFrame([], SCHEMA), labels(spark)).collect() == []


def test_cutoffs_keep_the_risk(spark):
    rng = random.Random(4)
    rows, truth = [], []
    for i in range(6000):
        bad = i % 10 == 0
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(15)) + (" $$$$$$$$" if bad or rng.random() < 0.001 else "")
        rows.append((i, text, "en" if i % 20 < 18 else "de", "s", 0, "", "", 0))
        truth.append((i, int(not bad), 0))
    measures = risk_rules.measures(odd_documents(spark, rows)).cache()
    cuts = {(r.stratum, r.rule): r for r in risk_rules.choose_cutoffs(measures, labels(spark, truth)).collect()}
    # The small stratum has too few good documents for any cutoff.
    assert set(cuts) == {("en", "symbol_share")}
    used = cuts["en", "symbol_share"]
    assert used.bad_caught == 600 and used.good_lost <= risk_rules.RISK * used.good
    # The same cutoffs under a risk that the labels cannot prove.
    assert risk_rules.choose_cutoffs(measures, labels(spark, truth), risk=1e-4).collect() == []
    measures.unpersist()


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    rows = [(k, n) for n in (1, 20, 3000) for k in (0, 1, 5, 30) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", risk_rules.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        assert r.p == pytest.approx(sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)
