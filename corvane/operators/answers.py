"""Citations, claimed references, answer checks, grounding decisions and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import text as X
from corvane.operators.ranking import first_per_key

# Label forms, lint thresholds and codes.
RULE_LABEL = "규칙 "
TERM_LABEL = "용어의 정의 "
MENTION = "(" + X.RULE_NO + r"(?:\s*[⒜-⒵⑴-⒇]+)?)"
MENTION_TAIL_CHARS = 12
BLOCKING_CODES = ("REFUSAL_INSIDE_ANSWER", "EMPTY_HEADLINE")
MIN_HEADLINE_CHARS = 10
MIN_DETAIL_CHARS = 8
TERM_RULE_BULLETS = (2, 5)
MAX_RENDERED_CHARS = 2500
MARKDOWN = r"(?m)^\s*[#>*+]|^\s*-\s|\||<\w+|\$"
RULE_REF = r"^[1-9]\.\d{2}"
TERM_REF = r"(?i)^DEF-(\d+)$"

POINT = "array<struct<label:string,detail:string,rule_ref:string>>"
ANSWER_SCHEMA = (
    "kind string, answerable boolean, refusal string, headline string, definition string, ruling string, "
    f"outcome string, points {POINT}, variations {POINT}, "
    "facts array<struct<label:string,value:string,as_of:string>>, example string, why string, "
    "extra_notes array<string>, caveats array<string>, evidence array<string>, as_of string, "
    f"sub_answers array<struct<question:string,kind:string,headline:string,points:{POINT},evidence:array<string>>>"
)


def parse_answers(rows: DataFrame, *, payload: str = "payload") -> DataFrame:
    """Strict answer JSON: unknown or missing fields put the row into `bad`, never into `doc`."""
    known = {f.split(" ")[0] for f in _top_level(ANSWER_SCHEMA)}
    keys = F.json_object_keys(payload)
    whole = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in sorted(known)]))) == 0
    full = F.size(keys) == len(known)
    doc = F.from_json(payload, ANSWER_SCHEMA, {"mode": "PERMISSIVE"})
    ok = keys.isNotNull() & whole & full
    return rows.withColumn("bad", F.coalesce(~ok, F.lit(True))).withColumn("doc", F.when(~F.col("bad"), doc))


def _top_level(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def rule_mentions(answers: DataFrame, *, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, pos, label, rule_no): each differently labelled rule mention once, at its first place."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(MENTION), F.lit(1))

    def labelled(m: Column) -> Column:
        tail = X.strip(F.substring(m, F.lit(5), F.lit(MENTION_TAIL_CHARS)))
        return F.concat(F.lit(RULE_LABEL), F.substring(m, 1, 4), tail)

    labels = F.array_distinct(F.transform(found, labelled))
    return answers.select(key, F.posexplode(labels).alias("pos", "label")).withColumn(
        "rule_no", F.substring("label", len(RULE_LABEL) + 1, 4)
    )


def term_mentions(answers: DataFrame, *, key: str = "answer_id", text: str = "text") -> DataFrame:
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(X.TERM_EN), F.lit(1))
    names = F.array_distinct(F.transform(found, lambda m: F.upper(X.strip(m))))
    return answers.select(key, F.posexplode(names).alias("pos", "name"))


def _first_doc(retrieved: DataFrame, key: str, by: Column, name: str) -> DataFrame:
    row = F.struct("doc_type", "page_start", "content", "term_no", "term_en")
    named = retrieved.withColumn(name, by).where(F.col(name).isNotNull())
    return first_per_key(named, [key, name], F.col("rank")).select(key, name, row.alias("_doc"))


def backed_citations(answers: DataFrame, retrieved: DataFrame, *, key: str = "answer_id", text: str = "text") -> DataFrame:
    """Mentions backed by the first retrieved chunk with that rule number or term.

    retrieved: key, rank, rule_no, term_no, term_en, doc_type, page_start, content.
    """
    page = F.coalesce("_doc.page_start", F.lit(0)).cast("int").alias("page")
    snippet = X.snippet(F.coalesce("_doc.content", F.lit(""))).alias("snippet")
    rules = rule_mentions(answers, key=key, text=text).join(
        _first_doc(retrieved, key, F.col("rule_no"), "rule_no"), [key, "rule_no"]
    )
    terms = term_mentions(answers, key=key, text=text).join(
        _first_doc(retrieved, key, F.upper(F.nullif(F.col("term_en"), F.lit(""))), "name"), [key, "name"]
    )
    rule_rows = rules.select(
        key, F.lit(0).alias("part"), "pos", "label", X.normalize_rule_id(F.col("label")).alias("rule_id"),
        F.coalesce("_doc.doc_type", F.lit("rule")).alias("doc_type"), page, snippet,
    )
    number = F.col("_doc.term_no").cast("string")
    term_rows = terms.select(
        key, F.lit(1).alias("part"), "pos",
        F.concat(F.lit(TERM_LABEL), number, F.lit(". "), F.col("_doc.term_en")).alias("label"),
        F.concat(F.lit("DEF-"), number).alias("rule_id"), F.lit("term").alias("doc_type"), page, snippet,
    )
    return rule_rows.unionByName(term_rows)


def dropped_citations(answers: DataFrame, retrieved: DataFrame, *, key: str = "answer_id", text: str = "text") -> DataFrame:
    backing = retrieved.where(F.col("rule_no").isNotNull()).select(key, "rule_no").distinct()
    return rule_mentions(answers, key=key, text=text).join(backing, [key, "rule_no"], "left_anti").select(key, "pos", "label")


def _norm(text: Column) -> Column:
    return X.nfkc(X.strip(F.coalesce(text, F.lit(""))))


def _norm_each(items: Column) -> Column:
    """One normalisation call for a whole array."""
    gap = "\u0001"
    return F.when(F.size(items) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.split(X.nfkc(F.array_join(items, gap)), gap), X.strip)
    )


def is_backed(ref: Column, backing: Column) -> Column:
    """Same reference, same term, or one rule number continuing the other."""
    term = F.concat(F.lit("DEF-"), F.regexp_extract(ref, TERM_REF, 1))
    return (
        F.array_contains(backing, ref)
        | (ref.rlike(TERM_REF) & F.array_contains(backing, term))
        | (ref.rlike(RULE_REF) & F.exists(backing, lambda b: b.startswith(ref) | ref.startswith(b)))
    )


def unbacked_refs(claims: DataFrame, *, claimed: str = "claimed", backing: str = "backing") -> DataFrame:
    """Adds `unbacked`: sorted claimed references that no backing reference supports."""
    normal = claims.withColumn("_c", _norm_each(F.col(claimed)))
    pairs = F.arrays_zip(F.col(claimed).alias("raw"), F.col("_c").alias("norm"))
    bad = F.filter(pairs, lambda p: ~is_backed(p["norm"], F.col(backing)))
    return normal.withColumn(
        "unbacked", F.array_sort(F.array_distinct(F.transform(bad, lambda p: p["raw"])))
    ).drop("_c")


def _strings(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def _doc(name: str) -> Column:
    return F.col(f"doc.{name}")


def _parts(group: Column, *fields: str) -> Column:
    return F.coalesce(
        F.flatten(F.transform(group, lambda p: F.array(*[p[f] for f in fields]))), F.array().cast("array<string>")
    )


def text_fields() -> Column:
    """Every free text of an answer, in document order."""
    singles = F.array(*[_doc(n) for n in ("headline", "definition", "ruling", "outcome", "example", "why")])
    subs = F.coalesce(
        F.flatten(
            F.transform(_doc("sub_answers"), lambda s: F.concat(F.array(s["question"], s["headline"]), _parts(s["points"], "label", "detail")))
        ),
        F.array().cast("array<string>"),
    )
    everything = F.concat(
        singles, _strings(_doc("extra_notes")), _strings(_doc("caveats")), _parts(_doc("points"), "label", "detail"),
        _parts(_doc("variations"), "label", "detail"), _parts(_doc("facts"), "label", "value"), subs,
    )
    return F.transform(everything, lambda t: F.coalesce(t, F.lit("")))


def claimed_refs() -> Column:
    """Rule-like evidence and every rule_ref, also of the sub-answers."""

    def rule_like(items: Column) -> Column:
        return F.filter(_strings(items), lambda e: X.strip(e).rlike(RULE_REF) | X.strip(e).rlike(TERM_REF))

    def refs(points: Column) -> Column:
        return F.filter(_parts(points, "rule_ref"), lambda r: F.coalesce(r, F.lit("")) != "")

    subs = F.coalesce(
        F.flatten(F.transform(_doc("sub_answers"), lambda s: F.concat(rule_like(s["evidence"]), refs(s["points"])))),
        F.array().cast("array<string>"),
    )
    return F.concat(rule_like(_doc("evidence")), refs(_doc("points")), refs(_doc("variations")), subs)


def lint_answers(answers: DataFrame) -> DataFrame:
    """Adds `codes`, `blocked` and the status flip `refusal_after`.

    answers: doc (answer struct), backing array<string> of retrieved references, knowledge_only boolean.
    """
    refused = ~_doc("answerable") | (_doc("refusal") != "none")
    ready = answers.withColumn("_texts", text_fields()).withColumn("_claimed", claimed_refs())
    ready = ready.withColumn("_norms", _norm_each(F.col("_texts")))
    ready = unbacked_refs(ready, claimed="_claimed", backing="backing")
    head, definition, as_of, ruling = F.col("_norms")[0], F.col("_norms")[1], _norm(_doc("as_of")), F.col("_norms")[2]
    refusal = F.exists("_norms", lambda t: t.rlike(L.OFF_TOPIC.java) | t.rlike(L.NOT_IN_CONTEXT.java))

    def stub(points: Column) -> Column:
        def thin(p: Column) -> Column:
            detail, label = X.strip(F.coalesce(p["detail"], F.lit(""))), X.strip(F.coalesce(p["label"], F.lit("")))
            return (F.length(detail) < MIN_DETAIL_CHARS) | (detail == label)

        return F.coalesce(F.exists(points, thin), F.lit(False))

    low, high = TERM_RULE_BULLETS
    kind = _doc("kind")
    n_points = F.coalesce(F.size(_doc("points")), F.lit(0))
    situational = (
        (F.coalesce(_doc("ruling"), F.lit("")) != "")
        | (F.coalesce(_doc("outcome"), F.lit("")) != "")
        | (F.size(F.coalesce(_doc("variations"), F.array().cast(POINT))) > 0)
    )
    has_facts = F.coalesce(F.size(_doc("facts")), F.lit(0)) > 0
    unbacked = F.when(F.col("knowledge_only"), F.size("_claimed") > 0).otherwise(
        (F.size("backing") > 0) & (F.size("unbacked") > 0)
    )
    length = F.aggregate("_texts", F.lit(0), lambda a, t: a + F.length(t))
    checks = [
        ("REFUSAL_INSIDE_ANSWER", refusal),
        ("EMPTY_HEADLINE", head == ""),
        ("SHORT_HEADLINE", (head != "") & (F.length(head) < MIN_HEADLINE_CHARS)),
        ("MARKDOWN_INJECTION", F.exists("_texts", lambda t: t.rlike(MARKDOWN))),
        ("STUB_SECTION", stub(_doc("points")) | stub(_doc("variations"))),
        ("BULLET_COUNT", (kind == "term_rule") & ~n_points.between(low, high)),
        ("UNBACKED_RULE_REF", unbacked),
        ("KIND_FIELD_MISMATCH", F.when(kind == "situation", ruling == "").otherwise(situational)),
        ("KIND_FIELD_MISMATCH", ~kind.isin("entity", "latest") & has_facts),
        ("LATEST_NO_AS_OF", (kind == "latest") & (as_of == "")),
        ("DUP_TEXT", (definition != "") & (definition == head)),
        ("TOO_LONG", length > MAX_RENDERED_CHARS),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks]))
    return (
        ready.withColumn("codes", F.when(refused, F.array().cast("array<string>")).otherwise(codes))
        .withColumn("blocked", F.arrays_overlap("codes", F.array(*[F.lit(c) for c in BLOCKING_CODES])))
        .withColumn("refusal_after", F.when(F.col("blocked"), F.lit("not_in_context")).otherwise(_doc("refusal")))
        .drop("_texts", "_claimed", "_norms", "unbacked")
    )


def prepare_gate(turns: DataFrame, *, live: L.Pattern = L.LIVE) -> DataFrame:
    """What a turn may answer from, before generation.

    turns: question, route, rule_hit, abstain, n_docs, n_latest, league_freshness array<string>,
    tools_available, knowledge_enabled. Adds docs_kept, needs_live, knowledge_only, freshness and gate
    (null when the turn goes on).
    """
    any_league = F.size("league_freshness") > 0
    has_data = any_league | (F.col("n_latest") > 0)
    fresh = F.exists("league_freshness", lambda f: f.isin("live", "cached"))
    docs = F.when(F.col("abstain"), F.lit(0)).otherwise(F.col("n_docs"))
    pure_latest = has_data & (F.col("route") == "latest") & ~F.col("rule_hit")
    kept = turns.withColumn("docs_kept", F.when(pure_latest, F.lit(0)).otherwise(docs))
    nothing = (F.col("docs_kept") == 0) & ~has_data
    needs_live = nothing & L.hit(X.nfkc(F.col("question")), live)
    can_know = F.col("knowledge_enabled") & ~F.col("needs_live")
    base = F.when(any_league & fresh, F.lit("live")).when(has_data, F.lit("snapshot")).otherwise(F.lit("static"))
    pending = F.col("route").isin("latest", "mixed") & F.col("needs_live")
    return (
        kept.withColumn("needs_live", needs_live)
        .withColumn("knowledge_only", nothing & (F.col("tools_available") | can_know))
        .withColumn("freshness", F.when(F.col("knowledge_only"), F.lit("model")).otherwise(base))
        .withColumn(
            "gate",
            F.when(nothing & ~F.col("knowledge_only"), F.when(pending, F.lit("phase2_pending")).otherwise(F.lit("not_in_rulebook"))),
        )
    )


def finish_gate(turns: DataFrame, *, text: str = "answer") -> DataFrame:
    """Aligns the finished turn with what really backs it.

    turns: answer, docs_kept, needs_live, knowledge_only, freshness, n_tool_calls, n_tool_sources,
    n_live_sources, n_citations. A live question answered without a tool call becomes a refusal in
    every field.
    """
    from corvane.operators.classify import answer_status

    down = F.col("needs_live") & (F.col("n_tool_calls") == 0)
    tools = F.col("n_tool_sources") > 0
    unused = (F.col("docs_kept") > 0) & (F.col("n_citations") == 0)
    unverified = unused & (F.col("n_live_sources") == 0) & tools
    turned = turns.withColumn("downgraded", down)
    answer = F.when(F.col("downgraded"), F.lit(L.NOT_IN_CONTEXT_REFUSAL)).otherwise(F.col(text))
    return (
        turned.withColumn(text, answer)
        .withColumn(
            "status", F.when(F.col("downgraded"), F.lit("phase2_pending")).otherwise(answer_status(X.nfkc(F.col(text))))
        )
        .withColumn("keeps_rule_sources", ~((F.col("n_citations") == 0) & tools))
        .withColumn("adds_model_source", ~F.col("downgraded") & ((F.col("knowledge_only") & ~tools) | unverified))
        .withColumn(
            "freshness",
            F.when(F.col("downgraded"), F.lit("static"))
            .when(tools & F.col("freshness").isin("static", "model"), F.lit("web"))
            .otherwise(F.col("freshness")),
        )
    )


def dedupe_sources(sources: DataFrame, keys: list[str] | None = None, *, position: str = "position") -> DataFrame:
    """First source per url, else per label, else one."""
    same = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("label"), F.lit("")), F.lit(""))
    return first_per_key(sources, [*(keys or []), same], F.col(position))


def assemble_sources(rule: DataFrame, live: DataFrame, tool: DataFrame, flags: DataFrame) -> DataFrame:
    """Sources of a turn: rule, live, tool and model rows; columns turn_id, kind, label, url, as_of, confidence, position.

    flags: turn_id, keeps_rule_sources, adds_model_source.
    """
    kept = rule.join(flags.where("keeps_rule_sources").select("turn_id"), "turn_id", "left_semi")
    unique = dedupe_sources(tool, ["turn_id"])
    null = F.lit(None).cast("string")
    model = flags.where("adds_model_source").select(
        "turn_id", F.lit("model").alias("kind"), F.lit("모델 일반 지식").alias("label"), null.alias("url"),
        null.alias("as_of"), F.lit("uncertain").alias("confidence"), F.lit(0).alias("position"),
    )
    parts = [kept, live, unique, model]
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)))
    return out
