"""Quality rules whose cutoffs are chosen under a bounded risk of rejecting good documents.

Every rule rejects what lies above a cutoff of one measure. For each stratum, rule and candidate cutoff, the labelled
good documents are a holdout: a cutoff may be used if the exact binomial probability of so few rejections, were the
true rate `risk`, is at most delta divided by the number of tests made (Bonferroni). So with a confidence of 1 - delta
no rule in use rejects more than a share of `risk` of the good documents of any stratum. Of the cutoffs allowed, the
one that rejects most bad documents for the good ones it costs is taken; a stratum with too few labels uses none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import BLANKS, WORD, row_key, stored

#: The measures and their candidate cutoffs.
CUTOFFS = {
    "symbol_share": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "shout_share": (0.02, 0.05, 0.1, 0.2, 0.5),
    "upper_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2),
}
RISK, DELTA = 0.01, 0.05
#: Bad documents that a rule must catch for every good one it costs.
PRICE = 20
WINDOW = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows of a text, in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"))
    return F.aggregate(at, start, step, lambda s: s["n"])


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, stratum, counts and shares) of every row, from its whole text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("rk"),
        F.col("lang").cast("string").alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.withColumn("words", words).withColumn("lines", lines)
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", hashes).drop("words")
    last = F.col("n_words").cast("int") - WINDOW
    window = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)]))
    rows = rows.withColumn("windows", F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("n_repeat_words", F.when(repeated, _covered(F.col("windows"))).otherwise(0).cast("long"))
    rows = rows.select(
        "doc_id", "rk", "stratum", "n_words", (F.length("text") - _without("text", BLANKS)).cast("long").alias("word_chars"),
        _without("text", "#*$%&|<>").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", _without("text", "!").alias("shouts"), _without("text", _UPPER).alias("upper"), F.size("lines").alias("n_lines"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return rows.select(
        "doc_id", "rk", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("shouts", "n_words").alias("shout_share"),
        share("upper", "word_chars").alias("upper_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial distribution, by its terms in logarithms."""
    zero = n.cast("double") * math.log1p(-p)
    start = F.struct(zero.alias("log"), F.exp(zero).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n.cast("double") - i + 1) / i) + math.log(p / (1 - p))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step, lambda s: s["sum"])


def choose_cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, good, good_lost, bad_caught): the cutoff in use of each stratum and rule."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    tests = [(rule, cut) for rule, cuts in CUTOFFS.items() for cut in cuts]
    over = [F.sum(F.when((F.col("y") == y) & (F.col(rule) > cut), 1).otherwise(0)) for rule, cut in tests for y in (1, 0)]
    names = [f"{kind}{i}" for i in range(len(tests)) for kind in "gb"]
    counts = rows.join(known, "doc_id").groupBy("stratum").agg(F.sum("y").alias("good"), *[c.alias(n) for c, n in zip(over, names)])
    each = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cutoff"), F.col(f"g{i}").alias("good_lost"), F.col(f"b{i}").alias("bad_caught"))
        for i, (rule, cut) in enumerate(tests)
    ]))
    counts = counts.filter("good > 0")
    made = counts.select(F.count(F.lit(1)) * len(tests)).scalar()
    rated = counts.select("stratum", "good", each.alias("t")).select("stratum", "good", "t.*")
    rated = rated.filter((F.col("bad_caught") > PRICE * F.col("good_lost")) & (F.col("good_lost") <= risk * F.col("good")))
    rated = rated.filter(binomial_tail(F.col("good_lost"), F.col("good"), risk) <= delta / made)
    gain = F.col("bad_caught") - PRICE * F.col("good_lost")
    best = Window.partitionBy("stratum", "rule").orderBy(gain.desc(), F.desc("cutoff"))
    return rated.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Judges every row of docs(doc_id, text, lang) by the rules, with cutoffs from labels(doc_id, quality 0/1).

    Returns doc_id, rk, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and reason, the
    first rule that rejects. base_failed: fewer than 10 words, or over a fifth of them in repeated 5-word windows.
    Defined results: a null or empty text has no words and fails; a null language is a stratum of its own; labels that
    are null or for unknown documents are ignored, and of labels that contradict each other the worse counts; without
    labels only base_failed rejects; repeated rows are judged each; an empty table gives no rows; other columns are
    ignored.
    """
    rows = stored(measures(docs), "measures")
    cuts = choose_cutoffs(rows, labels, risk, delta)
    wide = cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in CUTOFFS])
    both = rows.alias("d").join(wide.alias("c"), F.col("d.stratum").eqNullSafe(F.col("c.stratum")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    reason = F.coalesce(F.when(failed, F.lit("base")), *[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in CUTOFFS])
    return both.select(
        "doc_id", "rk", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        reason.isNull().alias("kept"), reason.alias("reason"),
    )
