"""Search operators against brute force."""

import math
import random
import tracemalloc
import unicodedata
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from corvane.operators import bm25, dense, fusion, graph, postings
from corvane.operators import ranking as R
from corvane.plans.hybrid import SearchIndex, search_channels

CORPUS = [
    (1, "[5.00] 5.09 아웃\n타자가 아웃되는 경우 balk"), (2, "BALK 보크\n투수의 반칙 투구 동작"), (3, "인필드 플라이\n내야수가 잡을 수 있는 플라이"),
    (4, "보크 보크 투수\nlong text about other things and other things"), (5, ""),
]


def brute_bm25(docs, query):
    import re

    def toks(s):
        return re.findall(r"[^\W_]{2,}|[a-z0-9]", s.lower()) + re.findall(r"(?<![\d.])([1-9]\.\d{2})(?![\d.])", s)

    corpus = {i: toks(t) for i, t in docs}
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = {}
    for words in corpus.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    out = {}
    for i, words in corpus.items():
        s = 0.0
        for q in toks(query):
            tf = words.count(q)
            s += idf.get(q, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg)) if tf else 0
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    return sorted(out.items(), key=lambda kv: (-kv[1], kv[0]))


def test_bm25_matches_brute_force(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    asked = ["보크 투수 보크", "balk", "아웃 5.09", "없는단어", "other things", "ＢＡＬＫ ５.０９"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    index = bm25.index_corpus(docs)
    rows = bm25.bm25_topk(index, bm25.query_terms(queries), 3).collect()
    for i, q in enumerate(asked):
        got = [(r["id"], round(r.score, 6)) for r in sorted(rows, key=lambda r: r["rank"]) if r.qid == i]
        assert got == brute_bm25(CORPUS, unicodedata.normalize("NFKC", q))[:3]


def test_systematic_sample_positions(spark):
    ids = sorted(random.Random(3).sample(range(10_000_000), 500))
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    got = sorted(r.doc_id for r in bm25.systematic_sample(docs, "doc_id").collect())
    assert got == ids[:: 500 // 30][:30]


def vectors(spark, n=300, dims=16, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(10, dims))
    rows = [(i, (centers[i % 10] + 0.3 * rng.normal(size=dims)).astype("float32").tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>"), np.asarray([r[1] for r in rows], dtype="float64")


def test_dense_exact_in_one_and_in_many_cells_and_tiles(spark, monkeypatch):
    df, m = vectors(spark)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    queries = df.withColumnRenamed("id", "qid")
    want = {i: sorted((j for j in range(300) if j != i), key=lambda j: (-sims[i, j], j))[:5] for i in range(300)}

    def check():
        rows = dense.dense_topk(df, queries, 5, exclude_self=True).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r.qid, []).append(r["id"])
        assert got == want

    check()
    monkeypatch.setattr(dense, "TILE_ROWS", 13)
    monkeypatch.setattr(dense, "QUERY_ROWS", 100)
    check()
    cells = dense.pivot_cells(df, 25)
    found = dense.search_cells(cells, queries, 5, exclude_self=True)
    assert sorted((r.qid, r["id"], r["rank"]) for r in found.hits.collect()) == sorted((i, j, n) for i in want for n, j in enumerate(want[i]))
    # Ten clusters: the triangle inequality spares most of the cells.
    row = found.compared_share(cells).first()
    assert row.queries == 300 and row.share < 0.5


def test_dense_ties_zeros_and_few_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 0.0]), (8, None)], "qid long, embedding array<float>")
    for pivots in (1, 3):
        found = dense.search_cells(dense.pivot_cells(df, pivots), queries, 3, exclude_self=True).hits.collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.qid, r["rank"])):
            got.setdefault(r.qid, []).append((r["id"], r.score))
        assert got == {1: [(2, 1.0), (3, 0.0), (5, 0.0)], 9: [(1, 0.0), (2, 0.0), (3, 0.0)]}
    assert dense.dense_topk(df.limit(0), queries).collect() == [] and dense.dense_topk(df, queries.limit(0)).collect() == []


def test_graph_finds_nearly_all_and_compares_few(spark):
    """Vectors in clusters: at least 95 in 100 of the exact hits for at most a tenth of the comparisons."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(120, 32))
    x = centres[rng.integers(120, size=9000)] + 0.5 * rng.normal(size=(9000, 32))
    df = spark.createDataFrame([(i, v.astype("float32").tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    index = graph.build_graph(df).cache()
    queries = df.where("id % 45 = 0").withColumnRenamed("id", "qid")
    hits = graph.graph_hits(index, queries, 20, exclude_self=True).cache()
    found = R.best_k(hits.select("qid", "id", "score"), 20)
    exact = dense.dense_topk(df, queries, 20, exclude_self=True)
    row, share = dense.recall(found, exact).first(), graph.compared_share(hits, 9000).first()
    assert row.exact_hits == 4000 and row.recall >= 0.95 and share.queries == 200 and share.share <= 0.1
    scores = {(r.qid, r["id"]): r.score for r in exact.collect()}
    assert all(scores.get((r.qid, r["id"]), r.score) == r.score for r in found.collect())
    index.unpersist()
    hits.unpersist()


def test_segments_are_cut_within_a_batch(monkeypatch):
    """A task holds the arrays of one segment, however many documents come in a batch."""
    monkeypatch.setattr(postings, "SEGMENT", 50)
    task = SimpleNamespace(partitionId=lambda: 3)
    monkeypatch.setattr(postings, "TaskContext", SimpleNamespace(get=lambda: task))
    docs = [[f"w{j % 7}" for j in range(i % 9)] for i in range(200)] + [["long"] * 120, []]
    whole = pa.record_batch({"id": pa.array(range(len(docs))), "tokens": pa.array(docs, pa.list_(pa.string()))})
    batches = [whole.slice(0, 150), whole.slice(150, 0), whole.slice(150)]
    listed = [b.filter(pc.is_null(b.column("term"))) for b in postings._segments(iter(batches))]
    assert [b.column("part")[0].as_py() for b in listed] == [(3 << 20) + i for i in range(len(listed))]
    lengths = [[x or 0 for x in b.column("lengths")[0].as_py()] for b in listed]
    assert [i for b in listed for i in b.column("ids")[0].as_py()] == list(range(len(docs)))
    assert all(sum(x[:-1]) < 50 for x in lengths) and all(sum(x) >= 50 for x in lengths[:-1])


def test_documents_reach_the_index_in_pieces(spark, monkeypatch):
    """No row holds a whole long text, and the pieces make the segments that whole documents make."""
    docs = [(i, None if i == 5 else [f"w{j * i % 11}" for j in range(i * 37 % 400)]) for i in range(60)]
    rows = postings._pieces(spark.createDataFrame(docs, "id long, tokens array<string>").coalesce(1)).toArrow()
    assert pc.max(pc.list_value_length(rows.column("tokens"))).as_py() == postings.PIECE < 400
    monkeypatch.setattr(postings, "SEGMENT", 1000)
    monkeypatch.setattr(postings, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    whole = pa.record_batch({"id": pa.array([d[0] for d in docs]), "tokens": pa.array([d[1] or [] for d in docs], pa.list_(pa.string()))})
    want = list(postings._segments(iter([whole])))
    assert len(want) > 5
    for size in (1, 3, 1000):
        got = list(postings._segments(iter(rows.combine_chunks().to_batches(max_chunksize=size))))
        assert [b.to_pydict() for b in got] == [b.to_pydict() for b in want]


def test_a_segment_holds_24_bytes_a_posting():
    texts = [[f"w{(i * j) % 997}" for j in range(40)] for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["id", "tokens"])
    segment = postings.Segment(pa.Table.from_batches([postings._segment(0, [batch])]), 40.0)
    held = (segment.docs, segment.values, segment.by_doc, segment.sorted_docs)
    assert sum(x.nbytes for x in held) <= 24 * len(segment.docs)


def test_a_large_tile_is_searched_in_small_products():
    """A tile of 16,384 vectors and 512 queries: beside the vectors, less than 64 MB of arrays at a time."""
    x = np.random.default_rng(2).normal(size=(dense.TILE_ROWS, 16))
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 16).cast(pa.list_(pa.float64()))
    ids = pa.array(np.arange(len(x)))
    vectors, asked = pa.table({"id": ids, "embedding": column}), pa.table({"qid": ids, "embedding": column}).slice(0, 512)
    tracemalloc.start()
    found = dense._best_of_tile(3, True)((), vectors, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 100, 511):
        scores = np.round(unit @ unit[q], dense.DIGITS)
        scores[q] = -9
        best = np.lexsort((np.arange(len(x)), -scores))[:3].tolist()
        assert found.filter(pc.equal(found.column("qid"), q)).column("id").to_pylist() == best
    assert peak < 64 << 20


def test_graph_widens_a_beam_that_misses_neighbours():
    """Without structure and with few links, neighbours are missed unless the beam fits the rows."""
    x = np.random.default_rng(8).normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = pa.array(np.arange(5000))
    rows = pa.table({"part": pa.array(np.zeros(5000, np.int32)), "order": ids, "id": ids, "embedding": pa.array(list(x))})
    built = graph._building(3, 8)(rows)
    asked = pa.table({"qid": ids, "embedding": rows.column("embedding")}).take(pa.array(np.arange(0, 5000, 100)))
    found = graph._searching(5, 6, True)((pa.scalar(0),), built, asked).to_pylist()
    exact = x[::100] @ x.T
    want = {(100 * i, j) for i, own in enumerate(np.argsort(-exact, axis=1)[:, :6].tolist()) for j in own if j != 100 * i}
    assert len({(r["qid"], r["id"]) for r in found} & want) >= 0.95 * len(want)


def test_graph_of_equal_and_few_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(500, [2.0, 1.0]), (501, None), (502, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 2.0]), (900, [2.0, 1.0])], "qid long, embedding array<float>")
    index = graph.build_graph(df)
    got = {}
    for r in sorted(graph.graph_topk(index, queries, 3, exclude_self=True).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append((r["id"], r.score))
    assert got == {7: [(0, 1.0), (1, 1.0), (2, 1.0)], 900: [(500, 1.0), (0, 0.8), (1, 0.8)]}
    assert graph.graph_topk(graph.build_graph(df.limit(0)), queries).collect() == []


def test_links_are_mutual_enough_to_reach_every_row():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = graph.links_of(x)
    seen, todo = {0}, [0]
    while todo:
        for j in links[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) == 700 and (links != np.arange(700)[:, None]).all()


def test_search_reads_fewer_postings_and_gives_the_same(spark, monkeypatch):
    """Queries of three words over a few thousand texts: the same hits as all postings give."""
    monkeypatch.setattr(postings, "BLOCK", 32)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(5, 80))) for _ in range(3000)]
    asked = [" ".join(texts[i].split()[:3]) for i in range(0, 3000, 75)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    index = bm25.index_corpus(docs)
    found = postings.hits(index, bm25.query_terms(queries), 5)
    got = {}
    for r in sorted(R.best_k(found.select("qid", "id", "score"), 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.qid, []).append((r["id"], round(r.score, 5)))
    corpus = list(enumerate(texts))
    for q, text in enumerate(asked):
        assert got[q] == [(i, round(s, 5)) for i, s in brute_bm25(corpus, text)[:5]]
    share = postings.read_share(found).first()
    assert 0 < share.read <= share.postings


def test_blocks_are_skipped():
    """A segment of 20,000 texts: at most half of the postings are read or looked up for queries of up to four words."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(20_000)]
    weights = [1 / (i + 1) for i in range(20_000)]
    texts = [rng.choices(vocabulary, weights, k=rng.randrange(5, 80)) for _ in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(texts)], ["id", "tokens"])
    segment = postings.Segment(pa.Table.from_batches([postings._segment(0, [batch])]), sum(map(len, texts)) / 20_000)
    df = np.diff(segment.upto[segment.first])
    idf = np.maximum(np.log(20_000 - df + 0.5) - np.log(df + 0.5), 0.1)
    number = {w: i for i, w in enumerate(segment.terms.to_pylist())}
    total = read = 0
    for i in range(0, 20_000, 400):
        terms = np.array(sorted({number[w] for w in texts[i][:4]}))
        docs, scores, n = segment.best(terms, idf[terms], 20)
        total, read = total + df[terms].sum(), read + n
        every = np.zeros(20_000)
        for t in terms:
            at = slice(segment.upto[segment.first[t]], segment.upto[segment.first[t + 1]])
            every[segment.docs[at]] += idf[t] * segment.values[at]
        every = np.round(every, 6)
        best = np.lexsort((np.arange(20_000), -every))[:20]
        assert docs.tolist() == [d for d in best if every[d] > 0]
    assert read <= 0.5 * total


def test_words_of_negative_weight_are_counted(spark):
    """In two texts every shared word has a negative idf, and so may the mean."""
    docs = [(1, "aa bb aa cc"), (2, "aa bb dd"), (3, "aa")]
    index = bm25.index_corpus(spark.createDataFrame(docs, "doc_id long, text string"))
    for text in ("aa", "aa cc", "bb aa dd", "zz"):
        rows = bm25.bm25_topk(index, bm25.query_terms(spark.createDataFrame([(0, text)], "qid long, text string")), 2).collect()
        assert [(r["id"], round(r.score, 6)) for r in sorted(rows, key=lambda r: r["rank"])] == brute_bm25(docs, text)[:2]
    empty = bm25.index_corpus(spark.createDataFrame([], "doc_id long, text string"))
    assert bm25.bm25_topk(empty, bm25.query_terms(spark.createDataFrame([(0, "aa")], "qid long, text string"))).collect() == []


def test_lsh_recall_on_random_vectors(spark):
    """Vectors without structure are the hardest case: at the default bits and tables 0.9 is still reached."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype("float32").tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = dense.lsh_index(df, dims=64).cache()
    queries = index.where("id % 30 = 0").withColumnRenamed("id", "qid")
    exact = dense.dense_topk(df, queries.drop("codes"), 10, exclude_self=True)
    near = dense.lsh_topk(index, queries, 10, exclude_self=True)
    row = dense.recall(near, exact).first()
    share = dense.lsh_candidates(index, queries, exclude_self=True).count() / (50 * 1499)
    assert row.exact_hits == 500 and row.recall > 0.85 and share < 0.7
    scores = {(r.qid, r["id"]): r.score for r in exact.collect()}
    assert all(scores.get((r.qid, r["id"]), r.score) == r.score for r in near.collect())
    index.unpersist()


def test_rrf_arithmetic_and_zero_weight(spark):
    hits = spark.createDataFrame(
        [(1, "dense", 0, "a", 0.9), (1, "dense", 1, "b", 0.8), (1, "bm25", 0, "b", 3.0), (1, "exact", 0, "c", 1.0)],
        "qid long, channel string, rank int, id string, score double",
    )
    got = {r["id"]: (r.score_fused, r.fused_rank) for r in fusion.rrf_fuse(hits).collect()}
    assert got["c"] == (round(1 / 61, 9), 1) and got["b"] == (round(0.5 / 62 + 0.5 / 61, 9), 2)
    zero = {r["id"]: r.score_fused for r in fusion.rrf_fuse(hits, {"exact": 1.0, "dense": 0.0, "bm25": 0.5}).collect()}
    assert zero["a"] == 0.0 and set(zero) == {"a", "b", "c"}


def test_context_floor_examples(spark):
    rows = [(1, i, s, 100) for i, s in enumerate((0.016393, 0.007143, 0.007, 0.006), 1)]
    ranked = spark.createDataFrame(rows, "qid long, position int, score_fused double, tokens long")
    assert fusion.select_context(ranked, min_docs=3).count() == 3
    assert fusion.select_context(ranked, min_docs=1).count() == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 1500)), min_size=1, max_size=12))
def test_context_selection_equals_the_walk(spark, items):
    items = sorted(items, key=lambda x: -x[0])
    top = max(s for s, _ in items)
    used, want = 0, []
    for i, (score, n) in enumerate(items, 1):
        if len(want) >= 6 or used + n > 3000:
            break
        if len(want) >= 3 and score < 0.55 * top:
            continue
        want.append(i)
        used += n
    ranked = spark.createDataFrame([(1, i, s, n) for i, (s, n) in enumerate(items, 1)], "qid long, position int, score_fused double, tokens long")
    assert sorted(r.position for r in fusion.select_context(ranked).collect()) == want


def chunk_rows(spark):
    rows = [
        ("a", "5.09", "⒜", 0, 400, 10, 10, "[5.00] 5.09 ⒜\nfirst", "[5.00] 5.09 ⒜"), ("b", "5.09", "⒝", 1, 400, 10, 11, "[5.00] 5.09 ⒝\nsecond", "[5.00] 5.09 ⒝"),
        ("c", "5.09", "⒞", 2, 400, 12, 12, "[5.00] 5.09 ⒞\nthird", "[5.00] 5.09 ⒞"), ("d", None, None, 3, 50, 20, 20, "[6.00]\nother", "[6.00]"),
        ("e", "6.01", "⒜", 4, 950, 30, 30, "[6.00] 6.01 ⒜\nbig", "[6.00] 6.01 ⒜"),
    ]
    schema = "id string, parent_id string, sub_item string, chunk_index int, tokens long, page_start int, page_end int, content string, breadcrumb string"
    return spark.createDataFrame(rows, schema)


def test_parent_expansion(spark):
    ranked = spark.createDataFrame(
        [(1, "d", 1, 0.9), (1, "b", 2, 0.8), (1, "e", 3, 0.7), (1, "a", 4, 0.6)], "qid long, id string, fused_rank int, score_fused double"
    )
    out = sorted(fusion.expand_parents(ranked, chunk_rows(spark)).collect(), key=lambda r: r.position)
    assert [r["id"] for r in out] == ["d", "parent:5.09", "e"]
    merged = out[1]
    assert (merged.tokens, merged.page_start, merged.page_end, merged.score_fused) == (800, 10, 11, 0.8)
    assert merged.content == "[5.00] 5.09 ⒜\n⒜ first\n⒝ second" and merged.breadcrumb == "[5.00] 5.09"


def test_exact_match_limits_per_query(spark):
    chunks = spark.createDataFrame([(f"c{i}", "5.09" if i % 2 else "6.01", i) for i in range(40)], "id string, rule_no string, chunk_index int")
    queries = spark.createDataFrame([(1, "5.09 그리고 6.01"), (2, "5.09"), (3, "3.141592")], "qid long, text string")
    rows = fusion.exact_match(queries, chunks).collect()
    got = {q: [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r.qid == q] for q in (1, 2, 3)}
    assert got[1] == [f"c{i}" for i in range(8)] and got[2] == [f"c{i}" for i in range(1, 17, 2)] and got[3] == []


def test_packing_numbers_and_budgets(spark):
    rows = [
        (1, "rule", 1, "r", "one two", None), (1, "latest", 1, "l", "three", None), (1, "league", 1, "k", "gone", "unavailable"),
        (1, "league", 2, "k", "four", "live"), (1, "rule", 2, "r", " ".join(["w"] * 50), None),
    ]
    blocks = spark.createDataFrame(rows, "qid long, block_type string, position int, head string, body string, freshness string")
    out = fusion.pack_context(blocks, budgets={"rule": 20, "latest": 20, "league": 20}).first()
    assert out.context == "[자료 1 | r]\none two\n\n[자료 2 | l]\nthree\n\n[자료 3 | k]\nfour" and out.n_blocks == 3
    only = spark.createDataFrame([(1,), (2,)], "qid long")
    got = {r.qid: r for r in fusion.pack_context(blocks, knowledge_only=only).collect()}
    assert len(got) == 2 and all("일반 지식" in r.context and r.n_blocks == 1 for r in got.values())


def test_top_n_salted_equals_direct(spark):
    rows = [(("hot" if i % 3 else f"k{i}"), random.Random(i).random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = {(r.k, r["id"], r["rank"]) for r in R.top_n_per_group(df, ["k"], [F.desc("v"), F.col("id")], 100).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:100]
        want |= {(k, r[2], i) for i, r in enumerate(mine, 1)}
    assert got == want


def test_top_n_plan_cuts_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = R.top_n_per_group(df, ["k"], [F.col("id")], 20)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_index_percentiles(spark):
    values = [random.Random(i).randint(1, 50) for i in range(333)]
    df = spark.createDataFrame([(v,) for v in values], "tokens int")
    total = F.col("total")
    row = R.index_percentiles(df, [], "tokens", {"p50": F.floor(total / 2), "p90": F.floor(total * 0.9)}).first()
    s = sorted(values)
    assert (row.p50, row.p90) == (s[333 // 2], s[int(333 * 0.9)])


def test_search_walks_the_graph_where_there_is_one(spark):
    df, _ = vectors(spark)
    chunks = spark.createDataFrame([(i, f"5.{i % 100:02d}", i, f"word{i} 5.{i % 100:02d}") for i in range(300)], "id long, rule_no string, chunk_index long, content string")
    index = SearchIndex(chunks, bm25.index_corpus(chunks, "id", "content"), df, spark.createDataFrame([(1.0,)], "ref_score double"))
    queries = spark.createDataFrame([(1, "what is 5.07"), (2, "word9")], "qid long, text string")
    asked = df.where("id in (1, 2)").withColumnRenamed("id", "qid")
    exact = sorted(tuple(r) for r in search_channels(queries, asked, index).collect())
    index.graph = graph.build_graph(df)
    assert sorted(tuple(r) for r in search_channels(queries, asked, index).collect()) == exact
    assert {r[1] for r in exact} == {"exact", "dense", "bm25"}
