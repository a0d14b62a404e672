"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Entities of fixed forms are the seeds. The words around them are lexical patterns; patterns and the values they occur
with form a graph on which both are scored in turn: a pattern by the share of its values that are known, a value by
the patterns it occurs in. Good patterns then find identifiers of no fixed form in the same contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import WORD, row_key, stored

# The forms of the seeds. Quantifiers are possessive and starts are bound to the ends of runs, which
# changes no match but keeps the time linear and the stack flat in very long texts.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier of no fixed form: a word with a digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Digits and characters that such an identifier has at least.
LEAST_DIGITS, LEAST_CHARS = 3, 5
#: Characters around a match that its context is taken from.
REACH = 80
#: Rounds of scoring; known values and share of known values that a pattern needs; score that a value needs.
ROUNDS, SUPPORT, CONFIDENCE, SCORE = 3, 4, 0.7, 0.7
_SPAN = "struct<start:int,k:int,end:int,value:string,left:string,right:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d >= 5, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, k: int, valid) -> Column:
    """Valid matches of a pattern with their places (code points) and contexts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("left"), F.slice(gaps, 2, F.size(found)).alias("right"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        begin = s["at"] + F.length(m["left"])
        end = begin + F.length(m["value"])
        span = F.struct(
            begin.alias("start"), F.lit(k).alias("k"), end.alias("end"), m["value"].alias("value"),
            F.substring(m["left"], -REACH, REACH).alias("left"), F.substring(m["right"], 1, REACH).alias("right"),
        ).cast(_SPAN)
        return F.struct(end.alias("at"), F.when(valid(m["value"]), F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda s: s["out"])


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, base, others) of every row: valid matches of the seeds, and further words with digits."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("rk"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    none = F.array().cast(f"array<{_SPAN}>")
    some = rows.withColumn("digits", F.col("text").rlike("[0-9]"))
    for k, (kind, pattern) in enumerate(KINDS.items()):
        # No kind but an address is found in a text without digits.
        maybe = F.contains("text", F.lit("@")) if kind == "email" else F.col("digits")
        some = some.withColumn(kind, F.when(maybe, _matches(F.col("text"), pattern, k, lambda v, kind=kind: _valid(kind, v))).otherwise(none))
    wanted = lambda v: (F.length(v) >= LEAST_CHARS) & (F.length(_digits(v)) >= LEAST_DIGITS)
    some = some.withColumn("others", F.when(F.col("digits"), _matches(F.col("text"), TOKEN, len(KINDS), wanted)).otherwise(none))
    some = some.withColumn("base", F.sort_array(F.concat(*KINDS))).drop("text", "digits", *KINDS)
    apart = F.filter("others", lambda o: ~F.exists("base", lambda b: (o["start"] < b["end"]) & (b["start"] < o["end"])))
    return some.select("doc_id", "rk", "base", F.when(F.size("base") > 0, apart).otherwise(F.col("others")).alias("others"))


def _around(side: str, last: int) -> Column:
    """Up to `last` lower-case words next to a match, without punctuation around them."""
    words = F.transform(F.regexp_extract_all(F.lower(side), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.slice(words, -last, last) if last > 1 else words


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, rk, start, end, value, k, patterns): every seed (k below the number of kinds) and other identifier."""
    each = rows.filter("size(base) + size(others) > 0").select("doc_id", "rk", F.explode(F.concat("base", "others")).alias("s")).select("doc_id", "rk", "s.*")
    each = each.withColumn("l", _around("left", 2)).withColumn("r", _around("right", 1))
    before = F.when(F.size("l") > 0, F.concat(F.lit("before "), F.array_join("l", " ")))
    between = F.when((F.size("l") > 0) & (F.size("r") > 0), F.concat(F.lit("between "), F.element_at("l", -1), F.lit(" / "), F.get("r", F.lit(0))))
    return each.select("doc_id", "rk", "start", "end", "k", F.lower("value").alias("value"), F.array_compact(F.array(before, between)).alias("patterns"))


def learn_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, kind, confidence): the patterns in use after the last round.

    Pattern and value are joined on pairs that are made distinct first; a hot pattern is summed before the shuffle.
    """
    kinds = len(KINDS)
    pairs = seen.select("value", "k", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.min("k").alias("k"))
    # Patterns with fewer values can never be used; values found in one round support patterns without seeds in the next.
    wide = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT)
    pairs = stored(pairs.join(wide, "pattern").select("pattern", "value", "k", "n"), "graph")
    seeds = pairs.filter(F.col("k") < kinds).groupBy("value").agg(F.min("k").alias("kind")).withColumn("score", F.lit(1.0))
    scores, used = seeds, None
    for _ in range(ROUNDS):
        held = pairs.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("known"), F.max("n").alias("n"))
        rated = held.withColumn("confidence", F.col("known") / F.col("n"))
        used = stored(rated.filter((F.col("known") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "kind", "confidence"), "patterns")
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        fresh = pairs.filter(F.col("k") >= kinds).join(used, "pattern").groupBy("value", "kind").agg((1 - miss).alias("score"))
        best = Window.partitionBy("value").orderBy(F.desc("score"), "kind")
        fresh = fresh.withColumn("place", F.row_number().over(best)).filter((F.col("place") == 1) & (F.col("score") >= SCORE)).drop("place")
        scores = seeds.union(fresh.join(seeds.select("value"), "value", "left_anti").select("value", "kind", "score"))
    return used


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of docs(doc_id, text): (doc_id, rk, base, found).

    base and found are arrays of (start, k, end), sorted, with k the number of the kind and places in code points, end
    exclusive; found also has the base spans. Defined results: a null or empty text has none; a null doc_id is searched
    like any other; repeated rows are searched each and count as one context; texts without seeds find no more than
    their base; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(base_spans(docs), "spans")
    seen = occurrences(rows).dropDuplicates(["rk", "start", "end", "k"])
    used = learn_patterns(seen)
    more = seen.filter(F.col("k") >= len(KINDS)).select("rk", "start", "end", F.explode("patterns").alias("pattern")).join(used, "pattern")
    best = Window.partitionBy("rk", "start", "end").orderBy(F.desc("confidence"), "kind")
    more = more.withColumn("place", F.row_number().over(best)).filter("place = 1")
    span = F.struct("start", F.col("kind").alias("k"), "end")
    extra = more.groupBy("rk").agg(F.collect_list(span).alias("extra"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    both = rows.join(extra, "rk", "left").select("doc_id", "rk", plain.alias("base"), "extra")
    return both.select("doc_id", "rk", "base", F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,k:int,end:int>>")))).alias("found"))


def counts(spans: str) -> list[Column]:
    """n_<kind> for every kind."""
    kinds = F.transform(spans, lambda s: s["k"])
    return [F.size(F.filter(kinds, lambda x: x == at)).cast("long").alias(f"n_{kind}") for at, kind in enumerate(KINDS)]


def digest(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat(F.get(names, s["k"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span found replaced by its kind in angle brackets, and n_chars counted anew.

    Overlapping spans are replaced together, by the kind of the first. Texts without spans stay as they are.
    """
    found = find(docs).filter("size(found) > 0").dropDuplicates(["rk"]).select(F.col("rk").alias("__rk"), F.col("found").alias("__found"))
    rows = docs.withColumn("__rk", row_key(F.col("doc_id"), F.col("text"))).join(found, "__rk", "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        piece = F.concat(F.substring(F.col("text"), s["at"] + 1, m["start"] - s["at"]), F.get(names, m["k"]))
        fresh = m["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.when(fresh, F.array_append(s["out"], piece)).otherwise(s["out"]).alias("out"))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(F.aggregate("__found", start, step, rest))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
