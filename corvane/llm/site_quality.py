"""Quality by hierarchical empirical Bayes: the evidence of a document with what is known of its host and path.

A logistic model over simple text measures gives each document's evidence. Hosts and, below them, paths have quality
rates of their own: a host's rate is shrunk towards the global rate, a path's towards its host's, each by a Beta prior
whose strength comes from how much the groups differ (method of moments). A document's prior is its path's rate
without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import row_key, stored, text_bytes, text_slices, word_hashes, word_spans

FEATURES = [
    "log_words", "upper", "exclaims", "symbols", "bars", "digits", "echoes", "distinct", "word_bytes", "lines", "wide_bytes",
]
#: Labelled rows that the document model is fitted on, at most.
LABELS = 20_000
#: Groups that are sent to every task, at most; more are joined.
SENT_GROUPS = 100_000
_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "exclaims": b"!", "symbols": b"#*$%&<>", "bars": b"|", "digits": b"0123456789", "lines": b"\n"}


def _measures(column: pa.Array) -> np.ndarray:
    """The features of each text, one row for each."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    words, size = np.maximum(np.diff(first), 1), np.maximum(np.diff(offsets), 1)

    def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return upto[at[1:]] - upto[at[:-1]]

    n = {}
    for name, chars in _SETS.items():
        lut = np.zeros(256, bool)
        lut[list(chars)] = True
        n[name] = per_row(lut[raw], offsets)
    echo = np.zeros(len(h), bool)
    echo[1:] = h[1:] == h[:-1]
    begins = first[:-1][first[:-1] < len(h)]
    echo[begins] = False
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:])], float)
    wide = per_row(raw >= 128, offsets)
    letters = np.maximum(n["upper"] + n["lower"], 1)
    return np.stack([
        np.log1p(np.diff(first)), n["upper"] / letters, n["exclaims"] / words, n["symbols"] / words, n["bars"] / words, n["digits"] / size,
        per_row(echo, first) / words, distinct / words, per_row(~np.isin(raw, list(b" \t\n\x0b\x0c\r")), offsets) / words, n["lines"] / words, wide / size,
    ], axis=1)


def measured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, rk, host, path, x): the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                x = _measures(batch.column("text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "rk", "host", "path"]).columns, values], ["doc_id", "rk", "host", "path", "x"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("rk"), host.cast("string").alias("host"),
        path.cast("string").alias("path"), F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, rk long, host string, path string, x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights for the raw features, the constant last; zeros unless both classes are there."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] + 1 if x.ndim == 2 else len(FEATURES) + 1)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / spread
    return np.append(raw, w[-1] - raw @ mean)


def _strength(rows: DataFrame, n: Column, mean: Column, towards: Column) -> float:
    """How many documents a group's prior is worth: large if groups hardly differ, small if they do."""
    noise = towards * (1 - towards)
    got = rows.agg(
        F.sum(n * (mean - towards) ** 2).alias("between"), F.sum(noise).alias("noise"), F.sum(n).alias("n"), F.sum(n * noise).alias("nn")
    ).first()
    spare = (got["between"] or 0.0) - (got["noise"] or 0.0)
    if not got["n"] or spare <= 0:
        return 1e6
    return min(1e6, max(1.0, got["nn"] / spare))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, *, host: Column | None = None, path: Column | None = None, cutoff: float = 0.5) -> DataFrame:
    """Judges every row of docs(doc_id, text, ...) from labels(doc_id, quality 0/1).

    Returns rk, doc_id, host, path, evidence (log odds), host_rate, path_rate, p_quality, kept. `host` and `path` are
    columns of docs; for tables without addresses the source stands for the host and the language for its section.
    Defined results: a null or empty text has zero features; null hosts or paths are groups of their own; labels that
    are null, or for unknown documents, are ignored, and of labels that contradict each other the worse counts;
    without labels of both kinds every document has even odds and is kept; repeated rows are judged each; an empty
    table gives no rows; other columns are ignored.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = stored(measured(docs, host, path), "measures")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS)
    seen = picked.join(rows.select("doc_id", "x"), "doc_id").select("x", "y").limit(2 * LABELS).collect()
    w = fit_logistic(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen]))
    terms = [F.col("x")[i] * F.lit(float(w[i])) for i in range(len(FEATURES))]
    evidence = sum(terms, F.lit(float(w[-1])))
    each = rows.select("rk", "doc_id", "host", "path", evidence.alias("evidence"))
    each = each.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least("evidence", F.lit(30.0)), F.lit(-30.0)))))
    sites = stored(each.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "sites")
    total = sites.agg(F.sum("n"), F.sum("s"), F.count(F.lit(1))).first()
    rate = total[1] / total[0] if total[0] else 0.5
    hosts = sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    k_host = _strength(hosts, F.col("hn"), F.col("hs") / F.col("hn"), F.lit(rate))
    joined = sites.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "path", "n", "s", "hn", "hs")
    joined = joined.withColumn("host_mean", (F.col("hs") + k_host * rate) / (F.col("hn") + k_host))
    k_path = _strength(joined, F.col("n"), F.col("s") / F.col("n"), F.col("host_mean"))
    on = F.col("d.host").eqNullSafe(F.col("g.host")) & F.col("d.path").eqNullSafe(F.col("g.path"))
    groups = F.broadcast(joined) if total[2] <= SENT_GROUPS else joined
    both = each.alias("d").join(groups.alias("g"), on).select("rk", "doc_id", "d.host", "d.path", "evidence", "p", "n", "s", "hn", "hs")
    both = both.withColumn("host_rate", (F.col("hs") - F.col("p") + k_host * rate) / (F.col("hn") - 1 + k_host))
    both = both.withColumn("path_rate", (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path))
    odds = F.col("evidence") - _logit(F.lit(rate)) + _logit(F.col("path_rate"))
    p = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))
    out = both.select("rk", "doc_id", "host", "path", "evidence", "host_rate", "path_rate", p.alias("p_quality"))
    return out.withColumn("kept", F.col("p_quality") >= cutoff - 1e-12)
