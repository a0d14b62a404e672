"""The pipeline on small tables, against plain loops where its stages have them."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import queries
from tests.llm.support import SCHEMA, prose, words
from tests.llm.test_near_dedup import brute


def corpus():
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(120):
        text = prose(rng, rng.randrange(30, 90), 3000)
        bad = i % 6 == 0
        if bad:
            text = text.upper() + " !!! $$$" * 20
        if i % 7 == 1:
            text += f" mail me{i}@host.example.org or +49 30 12345{i:03d} now"
        rows.append((i, text, "en", f"s{i % 3}", len(text), "k", "r", i))
        labels.append((i, int(not bad), 0))
    base = prose(rng, 100, 3000)
    rows += [(300 + i, base + f" tail{i}", "en", "s1", 1, "k", "r", i) for i in range(5)] + [rows[1], rows[1]]
    rows += [(400, None, None, None, None, None, None, None), (401, "", "en", "s0", 0, "", "", 0), (None, "no id at all here", None, None, None, None, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    labels = dict((i, y) for i, y, _ in corpus()[1])
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        assert n == 4 or made.columns == columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        kept.append([tuple(r) for r in docs.collect()])
    quality, unique, clean, mixed, packed = kept
    # The classifier rejects the bad documents and keeps the rest, repeated rows included.
    assert all(labels.get(r[0], 1) for r in quality)
    assert sum(labels.get(r[0], 1) for r in rows) - len(quality) <= 3
    # One document of each group stays.
    top = brute(quality, 5, 80)
    assert Counter(r[0] for r in unique) == Counter({d: 1 for d, _, c in top if d == c})
    # No personal data is left, nothing else is changed.
    old = {r[0]: r[1] for r in unique}
    for r in clean:
        assert not re.search(r"@|\+49", r[1] or "")
        assert r[1] == (re.sub(r"\+49 [0-9 ]+[0-9]", "<PHONE>", re.sub(r"\S+@\S+", "<EMAIL>", old[r[0]])) if old[r[0]] else old[r[0]])
    # The mix takes words of the documents only, up to three times each.
    size = Counter({r[0]: len(words(r[1])) for r in clean})
    taken = Counter()
    for r in mixed:
        taken[r[0]] += len(words(r[1]))
    assert all(n <= 3 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) <= 3
    # All pieces of the mix are packed.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r[3] for r in packed) == total
    fill = Counter()
    for r in packed:
        fill[r[5]] += r[3]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-total // 2048) + 1


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        docs = spark.createDataFrame(made.collect(), made.schema)
    one = Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert one == Counter(tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_one_query():
    numbers = Counter(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n)))
    assert numbers == Counter(range(1, 11)) and "pipeline" in queries.QUERIES
    assert np.all([callable(f) for f in queries.QUERIES.values()])
