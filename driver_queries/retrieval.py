"""Search queries: BM25, vectors, fusion, parent expansion, context, abstention, recall."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import bm25, dense, fusion, graph
from corvane.operators.matching import expand_query
from corvane.operators.postings import Index
from corvane.plans import evaluate
from corvane.plans.hybrid import SearchIndex, hybrid_search, search_channels
from corvane.session import stored_table
from driver_queries.base import Registry, sql_tokens, sql_words, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

# ---------------------------------------------------------------- SQL building blocks

INDEX_SQL = f"""
idx AS (SELECT doc_id AS id, {sql_tokens('text')} AS toks FROM documents),
idx_n AS (SELECT id, toks, len(toks)::DOUBLE AS dl FROM idx),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM idx_n),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(toks) AS term FROM idx_n) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)
"""

ASK_SQL = """
ask_plain AS (SELECT item_id AS qid, concat(text, ' ', 1 + item_id % 9, '.', lpad((item_id % 100)::VARCHAR, 2, '0'), ' ', n_name) AS text FROM benchmark JOIN nation ON n_nationkey = item_id % 25),
names AS (SELECT qid, unnest([n_name, concat('the ', lower(n_name))]) AS name FROM ask_plain JOIN nation ON contains(text, n_name)),
ask AS (SELECT qid, any_value(text) AS text, list(DISTINCT name) AS extra FROM ask_plain JOIN names USING (qid) GROUP BY qid)
"""

CHUNKS_SQL = f"""
chunks AS (SELECT doc_id AS id, concat(1 + doc_id % 9, '.', lpad((doc_id % 100)::VARCHAR, 2, '0')) AS rule_no,
  concat(source, '/', lang) AS parent_id, CASE WHEN doc_id % 2 = 0 THEN '⒜' END AS sub_item, doc_id AS chunk_index,
  greatest(len({sql_words('text')}), 1)::BIGINT AS tokens, 1 + doc_id % 50 AS page_start, 2 + doc_id % 50 AS page_end FROM documents)
"""


def bm25_sql(asked: str, k: int = 20, name: str = "bm25_hits", tokens: str | None = None) -> str:
    """CTEs `{name}` (qid, id, score, rank) for queries in `asked` (qid, text)."""
    toks = tokens or sql_tokens("text")
    return f"""
{name}_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({toks}) AS term FROM {asked}) GROUP BY ALL),
{name}_s AS (SELECT qid, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN post USING (term) JOIN idfs USING (term), corpus GROUP BY qid, id HAVING score > 0),
{name} AS (SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1)::INT AS rank FROM {name}_s
  QUALIFY rank < {k})
"""


def dense_sql(where: str, k: int = 20, name: str = "dense_hits") -> str:
    return f"""
{name}_s AS (SELECT q.vec_id AS qid, v.vec_id AS id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE {where}),
{name} AS (SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1)::INT AS rank FROM {name}_s
  QUALIFY rank < {k})
"""


EXACT_SQL = """
exact_hits AS (SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY chunk_index, id) - 1)::INT AS rank
  FROM ask JOIN chunks ON chunks.rule_no = concat(1 + qid % 9, '.', lpad((qid % 100)::VARCHAR, 2, '0')) QUALIFY rank < 8)
"""


def fuse_sql(weights: str = "CASE channel WHEN 'exact' THEN 1.0 ELSE 0.5 END", name: str = "fused") -> str:
    return f"""
{name}_s AS (SELECT qid, id, round(sum({weights} / (61 + rank)), 9)::DOUBLE AS score_fused,
    min(CASE channel WHEN 'exact' THEN 0 WHEN 'dense' THEN 1 ELSE 2 END * 1000 + rank) AS seen FROM channels GROUP BY qid, id),
{name} AS (SELECT qid, id, score_fused, row_number() OVER (PARTITION BY qid ORDER BY score_fused DESC, seen, id)::INT AS fused_rank
  FROM {name}_s)
"""


ASK_TOKENS = f"list_concat({sql_tokens('text')}, flatten(list_transform(extra, lambda e: {sql_tokens('e')})))"
ASK_VECTORS = "q.vec_id IN (SELECT item_id FROM benchmark)"

CHANNELS_SQL = f"""
WITH {INDEX_SQL}, {ASK_SQL}, {CHUNKS_SQL}, {bm25_sql('ask', tokens=ASK_TOKENS)}, {dense_sql(ASK_VECTORS)}, {EXACT_SQL},
channels AS (SELECT qid, 'exact' AS channel, rank, id, 1.0::DOUBLE AS score FROM exact_hits
  UNION ALL SELECT qid, 'dense', rank, id, score FROM dense_hits
  UNION ALL SELECT qid, 'bm25', rank, id, score FROM bm25_hits)
"""

EXPAND_SQL = """
pool AS (SELECT fused.qid, fused.fused_rank, fused.score_fused, chunks.* FROM fused JOIN chunks USING (id)),
wanted AS (SELECT DISTINCT qid, parent_id FROM pool WHERE fused_rank <= 3 AND sub_item IS NOT NULL),
sib AS (SELECT *, sum(tokens) OVER (PARTITION BY parent_id ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING) AS upto FROM chunks),
merged AS (SELECT parent_id, sum(tokens)::BIGINT AS m_tokens, min(page_start) AS m_p0, max(page_end) AS m_p1 FROM sib WHERE upto <= 900 GROUP BY parent_id),
expanded AS (SELECT pool.*, m_tokens, m_p0, m_p1, wanted.qid IS NOT NULL AND m_tokens IS NOT NULL AS merge
  FROM pool LEFT JOIN wanted ON wanted.qid = pool.qid AND wanted.parent_id = pool.parent_id LEFT JOIN merged ON merged.parent_id = pool.parent_id),
kept AS (SELECT * FROM expanded QUALIFY NOT merge OR row_number() OVER (PARTITION BY qid, parent_id ORDER BY fused_rank) = 1),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY fused_rank)::INT AS position, score_fused,
  CASE WHEN merge THEN concat('parent:', parent_id) ELSE id::VARCHAR END AS id, CASE WHEN merge THEN m_tokens ELSE tokens END AS tokens,
  CASE WHEN merge THEN m_p0 ELSE page_start END AS page_start, CASE WHEN merge THEN m_p1 ELSE page_end END AS page_end FROM kept)
"""

CONTEXT_SQL = """
walk AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY position ROWS UNBOUNDED PRECEDING)::BIGINT AS context_tokens,
  max(score_fused) OVER (PARTITION BY qid) AS best FROM ranked QUALIFY position <= 6),
picked AS (SELECT * FROM walk WHERE context_tokens <= 3000 AND (position <= 3 OR score_fused >= 0.55 * best))
"""

# ---------------------------------------------------------------- inputs


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def corpus_index(spark: SparkSession, sf: str) -> Index:
    return bm25.index_corpus(corpus(spark, sf))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items, each also naming a rule number (every other one in full-width characters) and a nation;
    `extra` holds what the glossary of nations adds to a question."""
    number = F.format_string("%d.%02d", 1 + F.col("item_id") % 9, F.col("item_id") % 100)
    wide = F.translate(number, "0123456789.", "０１２３４５６７８９．")
    nation = table(spark, sf, "nation").select((F.col("n_nationkey").cast("long")).alias("_n"), "n_name")
    shown = F.concat_ws(" ", "text", F.when(F.col("item_id") % 2 == 0, number).otherwise(wide), "n_name")
    items = table(spark, sf, "benchmark").withColumn("_n", F.col("item_id") % 25).join(nation, "_n")
    questions = items.select(F.col("item_id").alias("qid"), shown.alias("text"))
    name = F.col("n_name")
    glossary = nation.select(name.alias("term_en"), F.concat(F.lit("the "), F.lower(name)).alias("term_ko"), F.array(name).alias("aliases"))
    return expand_query(questions, glossary)


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of one rule book: numbered, grouped under a parent, with pages and tokens."""
    d = F.col("doc_id")
    return corpus(spark, sf).select(
        d.alias("id"),
        F.format_string("%d.%02d", 1 + d % 9, d % 100).alias("rule_no"),
        F.concat_ws("/", "source", "lang").alias("parent_id"),
        F.when(d % 2 == 0, F.lit("⒜")).alias("sub_item"),
        d.alias("chunk_index"),
        F.greatest(X.token_count(F.col("text")), F.lit(1)).cast("bigint").alias("tokens"),
        (1 + d % 50).alias("page_start"),
        (2 + d % 50).alias("page_end"),
        F.col("text").alias("content"),
        F.concat(F.lit("[1.00] "), "source").alias("breadcrumb"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return vectors(spark, sf).join(items, "id", "left_semi").withColumnRenamed("id", "qid")


def search_index(spark: SparkSession, sf: str) -> SearchIndex:
    terms = corpus_index(spark, sf)
    reference = bm25.bm25_reference(corpus(spark, sf), terms)
    return SearchIndex(stored_table(chunk_table(spark, sf), "chunks"), terms, vectors(spark, sf), reference)


# ---------------------------------------------------------------- queries


@R.add(
    "bm25_topk",
    f"WITH {INDEX_SQL}, ask AS (SELECT item_id AS qid, text FROM benchmark), {bm25_sql('ask')} SELECT qid, id, score, rank FROM bm25_hits",
)
def bm25_topk(spark, sf):
    queries = table(spark, sf, "benchmark").withColumnRenamed("item_id", "qid")
    return bm25.bm25_topk(corpus_index(spark, sf), bm25.query_terms(queries))


@R.add("bm25_term_stats", f"WITH {INDEX_SQL} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_term_stats(spark, sf):
    return bm25.term_stats(corpus_index(spark, sf)).withColumn("idf", F.round("idf", 6))


REFERENCE_SQL = f"""
numbered AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
sampled AS (SELECT doc_id AS qid, text FROM numbered WHERE pos % greatest(1, n // 30) = 0 AND pos < 30 * greatest(1, n // 30)),
short_q AS (SELECT qid, split_part(text, chr(10), 1) AS text FROM sampled),
long_q AS (SELECT qid, substr(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END, 1, 120) AS text FROM sampled),
{bm25_sql('short_q', 1, 'short_hits', f"list_slice({sql_tokens('text')}, 1, 3)")}, {bm25_sql('long_q', 1, 'long_hits')},
short_tops AS (SELECT list_sort(list(coalesce(score, 0.0))) AS t FROM (SELECT DISTINCT qid FROM short_hits_q) LEFT JOIN short_hits USING (qid)),
long_tops AS (SELECT list_sort(list(coalesce(score, 0.0))) AS t FROM long_q LEFT JOIN long_hits USING (qid))
"""
REF_VALUE = "greatest(t[1 + least(len(t) - 1, floor(len(t) * 0.9)::BIGINT)], 1e-6)"


@R.add(
    "bm25_reference",
    f"WITH {INDEX_SQL}, {REFERENCE_SQL} SELECT 'short' AS kind, {REF_VALUE} AS ref_score, len(t)::INT AS sampled FROM short_tops "
    f"UNION ALL SELECT 'sentence', {REF_VALUE}, len(t)::INT FROM long_tops",
)
def bm25_reference(spark, sf):
    docs, index = corpus(spark, sf), corpus_index(spark, sf)
    parts = [bm25.bm25_reference(docs, index, k).select(F.lit(k).alias("kind"), "ref_score", "sampled") for k in ("short", "sentence")]
    return parts[0].unionByName(parts[1])


@R.add("dense_topk", f"WITH {dense_sql(f'{ASK_VECTORS} AND q.vec_id <> v.vec_id')} SELECT qid, id, score, rank FROM dense_hits")
def dense_topk(spark, sf):
    return dense.dense_topk(vectors(spark, sf), query_vectors(spark, sf), exclude_self=True)


@R.add("graph_topk")
def graph_hits(spark, sf):
    """Hits of the walk over a stored graph of all vectors, for the benchmark's vectors."""
    index = stored_table(graph.build_graph(vectors(spark, sf)), "graph")
    return graph.graph_topk(index, query_vectors(spark, sf), exclude_self=True)


@R.add(
    "graph_recall",
    f"""WITH {dense_sql(f'{ASK_VECTORS} AND q.vec_id <> v.vec_id')}
    SELECT count(*) AS exact_hits, count(DISTINCT qid) AS queries, count(*) > 0 AS enough FROM dense_hits""",
)
def graph_recall(spark, sf):
    """Exact hits for the benchmark's vectors, and whether the graph finds 95 in 100 of them."""
    exact = stored_table(dense_topk(spark, sf), "exact")
    found = graph_hits(spark, sf).select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "id"], "left").agg(
        F.count(F.lit(1)).alias("exact_hits"), F.count_distinct("qid").alias("queries"),
        (F.count("hit") >= F.count(F.lit(1)) * 0.95).alias("enough"),
    )


LSH_SQL = f"""
places AS (SELECT t, b, d, (t * {dense.BITS} + b) * 64 + d + 1 AS a FROM range({dense.TABLES}) r(t), range({dense.BITS}) s(b), range(64) u(d)),
round1 AS (SELECT t, b, d, (a * 1103515245 + 12345) % 4294967296 AS a FROM places),
round2 AS (SELECT t, b, d, (xor(a, a >> 15) * 40503 + 12345) % 4294967296 AS a FROM round1),
round3 AS (SELECT t, b, d, (xor(a, a >> 15) * 69069 + 12345) % 4294967296 AS a FROM round2),
planes AS (SELECT t, b, list(xor(a, a >> 15) / 2147483648.0::DOUBLE - 1 ORDER BY d) AS plane FROM round3 GROUP BY t, b),
codes AS (SELECT vec_id, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], plane) >= 0 THEN 1 << b ELSE 0 END) AS code FROM embeddings, planes GROUP BY vec_id, t),
pairs AS (SELECT DISTINCT q.vec_id AS qid, v.vec_id AS id FROM codes q JOIN codes v USING (t, code) WHERE {ASK_VECTORS} AND q.vec_id <> v.vec_id),
near AS (SELECT qid, id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM pairs JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = id)
"""


@R.add(
    "lsh_topk",
    f"WITH {LSH_SQL} SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1)::INT AS rank FROM near QUALIFY rank < 20",
)
def lsh_topk(spark, sf):
    """Hits of the bucket search for the benchmark's vectors."""
    index = stored_table(dense.lsh_index(vectors(spark, sf), dims=64), "codes")
    questions = query_vectors(spark, sf).select(F.col("qid").alias("id")).join(index, "id").withColumnRenamed("id", "qid")
    return dense.lsh_topk(index, questions, exclude_self=True)


@R.add("vector_dims", "SELECT len(embedding)::INT AS dims, count(*) AS rows, len(embedding) = 64 AS ok FROM embeddings GROUP BY 1, 3")
def vector_dims(spark, sf):
    return dense.vector_dims(vectors(spark, sf), 64)


@R.add(
    "exact_match",
    f"WITH {ASK_SQL}, {CHUNKS_SQL}, {EXACT_SQL} SELECT qid, 'exact' AS channel, rank, id, 1.0::DOUBLE AS score FROM exact_hits",
)
def exact_match(spark, sf):
    return fusion.exact_match(asked(spark, sf), chunk_table(spark, sf))


@R.add("rrf_fuse", f"{CHANNELS_SQL}, {fuse_sql()} SELECT qid, id, score_fused, fused_rank FROM fused")
def rrf_fuse(spark, sf):
    hits = search_channels(asked(spark, sf), query_vectors(spark, sf), search_index(spark, sf), "extra")
    return fusion.rrf_fuse(hits)


@R.add(
    "fusion_baselines",
    f"""{CHANNELS_SQL}, {fuse_sql()}, {fuse_sql("CASE channel WHEN 'exact' THEN 1.0 WHEN 'dense' THEN 0.5 ELSE 0.0 END", 'fused_dense')},
    {fuse_sql("CASE channel WHEN 'exact' THEN 1.0 WHEN 'bm25' THEN 0.5 ELSE 0.0 END", 'fused_bm25')}
    SELECT 'rrf' AS baseline, * FROM fused WHERE fused_rank <= 6 UNION ALL SELECT 'dense', * FROM fused_dense WHERE fused_rank <= 6
    UNION ALL SELECT 'bm25', * FROM fused_bm25 WHERE fused_rank <= 6""",
)
def fusion_baselines(spark, sf):
    """Fusion with one channel weighted 0: its ids stay, at score 0."""
    hits = stored_table(search_channels(asked(spark, sf), query_vectors(spark, sf), search_index(spark, sf), "extra"), "hits")
    parts = [
        fusion.rrf_fuse(hits, w).where(F.col("fused_rank") <= 6).select(F.lit(name).alias("baseline"), "*")
        for name, w in evaluate.BASELINES.items()
    ]
    return fusion.union_channels(*parts)


@R.add(
    "hybrid_search",
    f"{CHANNELS_SQL}, {fuse_sql()}, {EXPAND_SQL}, {CONTEXT_SQL} SELECT qid, position, id, score_fused, tokens, page_start, page_end, context_tokens FROM picked",
)
def hybrid(spark, sf):
    found = hybrid_search(asked(spark, sf), query_vectors(spark, sf), search_index(spark, sf), extra="extra")
    return found.docs.select("qid", "position", "id", "score_fused", "tokens", "page_start", "page_end", "context_tokens")


@R.add(
    "abstain",
    f"""{CHANNELS_SQL}, {REFERENCE_SQL}, ref AS (SELECT {REF_VALUE} AS r FROM short_tops),
    sig AS (SELECT qid, coalesce(max(score) FILTER (channel = 'dense'), 0) AS dense_top, coalesce(max(score) FILTER (channel = 'bm25'), 0) AS bm25_max,
      count(*) FILTER (channel = 'exact')::INT AS n_exact, count(*) FILTER (channel = 'dense') = 0 AS dense_failed FROM channels GROUP BY qid)
    SELECT qid, dense_top, bm25_max, round(bm25_max / r, 6) AS bm25_ratio, n_exact, dense_failed,
      n_exact = 0 AND (NOT dense_failed AND dense_top < 0.3) AND bm25_max / r < 0.15 AS abstain FROM sig, ref""",
)
def abstain(spark, sf):
    found = hybrid_search(asked(spark, sf), query_vectors(spark, sf), search_index(spark, sf), extra="extra")
    return found.signals.select("qid", "dense_top", "bm25_max", "bm25_ratio", "n_exact", "dense_failed", "abstain")


RECALL_SQL = f"""
{CHANNELS_SQL}, {fuse_sql()}, {EXPAND_SQL}, {CONTEXT_SQL},
refs AS (SELECT qid, list(DISTINCT CASE WHEN starts_with(id, 'parent:') THEN substr(id, 8) ELSE source END) AS got
  FROM picked LEFT JOIN documents ON documents.doc_id::VARCHAR = picked.id GROUP BY qid),
want AS (SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN [] ELSE [concat('src', item_id % 20), concat('src', item_id * 7 % 20)] END AS expected FROM benchmark),
judged AS (SELECT want.qid, len(expected) > 0 AS scored, CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE
  len(list_filter(expected, lambda e: len(list_filter(coalesce(got, []), lambda r: starts_with(r, e))) > 0))::DOUBLE / len(expected) END AS recall
  FROM want LEFT JOIN refs USING (qid))
"""


def judged(spark, sf) -> DataFrame:
    """Recall per query with expected sources; every fifth item expects nothing."""
    found = hybrid_search(asked(spark, sf), query_vectors(spark, sf), search_index(spark, sf), extra="extra")
    sources = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    ref = F.when(F.col("id").startswith("parent:"), F.substring("id", 8, 99)).otherwise(F.col("source"))
    docs = found.docs.select("qid", "id", "position").join(sources, "id", "left").withColumn("rule_id", ref)
    i = F.col("item_id")
    want = F.array(F.concat(F.lit("src"), (i % 20).cast("string")), F.concat(F.lit("src"), (i * 7 % 20).cast("string")))
    cases = table(spark, sf, "benchmark").select(
        i.alias("qid"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(want).alias("expected")
    )
    return evaluate.recall_at_k(cases, evaluate.retrieved_refs(docs))


@R.add("recall_at_k", f"{RECALL_SQL} SELECT qid, scored, round(recall, 6) AS recall FROM judged")
def recall_at_k(spark, sf):
    return judged(spark, sf).select("qid", "scored", F.round("recall", 6).alias("recall"))


@R.add(
    "joined_results",
    f"""WITH {INDEX_SQL}, ask AS (SELECT item_id AS qid, text FROM benchmark), {bm25_sql('ask', 5)}
    SELECT qid, md5(string_agg(concat(text, chr(10), 'URL: ', source), concat(chr(10), '---', chr(10)) ORDER BY rank)) AS context
    FROM bm25_hits JOIN documents ON doc_id = id GROUP BY qid""",
)
def joined_results(spark, sf):
    queries = table(spark, sf, "benchmark").withColumnRenamed("item_id", "qid")
    hits = bm25.bm25_topk(corpus_index(spark, sf), bm25.query_terms(queries), bm25.LEGACY_TOP_K)
    return bm25.joined_results(hits, table(spark, sf, "documents")).select("qid", F.md5("context").alias("context"))


LINE_SQL = """
lines AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber)::INT AS position,
  l_extendedprice AS score_fused, (l_quantity * 60)::BIGINT AS tokens FROM lineitem)
"""


@R.add(
    "select_context",
    f"WITH {LINE_SQL}, ranked AS (FROM lines), {CONTEXT_SQL} SELECT qid, position, score_fused, tokens, context_tokens FROM picked",
)
def select_context(spark, sf):
    """Order lines as results: price is the score, quantity the length."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.col("l_extendedprice").alias("score_fused"),
        (F.col("l_quantity") * 60).cast("bigint").alias("tokens"), "l_partkey", "l_suppkey", "l_linenumber",
    )
    from corvane.operators.ranking import top_n_per_group

    order = [F.desc("score_fused"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")]
    ranked = top_n_per_group(rows, ["qid"], order, fusion.TOP_K, rank="position")
    return fusion.select_context(ranked).select("qid", "position", "score_fused", "tokens", "context_tokens")


BLOCKS_SQL = f"""
raw AS (SELECT conv_id AS qid, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS kind, turn AS position,
  concat(role, ' | turn ', turn, ' | part a') AS head, trim(text, ' ') AS body, CASE WHEN role = 'system' AND conv_id % 5 = 4 THEN 'unavailable' END AS freshness FROM conversations),
ready AS (SELECT *, len({sql_words("concat('자료 1 | ', head, chr(10), body)")}) AS cost FROM raw WHERE freshness IS NULL),
fits AS (SELECT *, sum(cost) OVER (PARTITION BY qid, kind ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM ready
  QUALIFY used <= CASE kind WHEN 0 THEN 120 WHEN 1 THEN 60 ELSE 40 END),
num AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kind, position) AS n FROM fits)
"""


@R.add(
    "pack_context",
    f"""WITH {BLOCKS_SQL} SELECT qid, md5(string_agg(concat('[자료 ', n, ' | ', head, ']', chr(10), body), concat(chr(10), chr(10)) ORDER BY n)) AS context,
    count(*) AS n_blocks, sum(cost)::BIGINT AS used FROM num GROUP BY qid""",
)
def pack_context(spark, sf):
    """A conversation's messages as blocks of three kinds with small budgets."""
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "assistant", F.lit("rule")).when(F.col("role") == "user", F.lit("latest")).otherwise(F.lit("league"))
    blocks = c.select(
        F.col("conv_id").alias("qid"), kind.alias("block_type"), F.col("turn").alias("position"),
        F.concat("role", F.lit(" | turn "), F.col("turn").cast("string"), F.lit(" | part a")).alias("head"),
        F.trim("text").alias("body"),
        F.when((F.col("role") == "system") & (F.col("conv_id") % 5 == 4), F.lit("unavailable")).alias("freshness"),
    )
    packed = fusion.pack_context(blocks, budgets={"rule": 120, "latest": 60, "league": 40})
    return packed.select("qid", F.md5("context").alias("context"), "n_blocks", "used")


@R.add(
    "expand_parents",
    f"""WITH chunks AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_orderkey::VARCHAR AS parent_id,
      CASE WHEN l_returnflag <> 'N' THEN '⑴' END AS sub_item, l_linenumber AS chunk_index, (l_quantity * 4)::BIGINT AS tokens,
      l_linenumber AS page_start, l_linenumber + 1 AS page_end, l_orderkey, l_extendedprice FROM lineitem),
    fused AS (SELECT o_custkey AS qid, id, round(1.0 / (60 + row_number() OVER w), 9)::DOUBLE AS score_fused, row_number() OVER w::INT AS fused_rank
      FROM chunks JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, id) QUALIFY fused_rank <= 20),
    {EXPAND_SQL.replace('chunks.*', 'chunks.* EXCLUDE (l_orderkey, l_extendedprice)')} SELECT qid, position, id, score_fused, tokens, page_start, page_end FROM ranked""",
)
def expand_parents(spark, sf):
    """A customer's dearest order lines as results, orders as their parents."""
    from corvane.operators.ranking import top_n_per_group

    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)
    lines = table(spark, sf, "lineitem").select(
        key.alias("id"), F.col("l_orderkey").cast("string").alias("parent_id"),
        F.when(F.col("l_returnflag") != "N", F.lit("⑴")).alias("sub_item"), F.col("l_linenumber").alias("chunk_index"),
        (F.col("l_quantity") * 4).cast("bigint").alias("tokens"), F.col("l_linenumber").alias("page_start"),
        (F.col("l_linenumber") + 1).alias("page_end"), F.lit("head\nbody").alias("content"), F.lit("[1.00] a").alias("breadcrumb"),
        "l_orderkey", "l_extendedprice",
    )
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("qid"))
    top = top_n_per_group(
        lines.select("id", "l_orderkey", "l_extendedprice").join(owners, "l_orderkey"),
        ["qid"], [F.desc("l_extendedprice"), F.col("id")], 20, rank="fused_rank",
    )
    ranked = top.select("qid", "id", "fused_rank", F.round(1.0 / (60 + F.col("fused_rank")), 9).alias("score_fused")).persist()
    out = fusion.expand_parents(ranked, lines.drop("l_orderkey", "l_extendedprice"))
    return out.select("qid", "position", "id", "score_fused", "tokens", "page_start", "page_end")
