"""Text decision queries: names, keywords, topics, route, scope, citations, answer checks, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import text as X
from corvane.functions import values as V
from corvane.operators import answers as A
from corvane.operators import classify as K
from corvane.operators import matching as M
from corvane.operators import media as P
from corvane.operators.classify import Lexicon
from driver_queries.base import Registry, sql_rule_numbers, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

# Word lists in the languages of the test texts, in place of the default Korean ones.
TEST_LEXICON = Lexicon(
    rule=L.Pattern("rule", "the |with"),
    latest=L.Pattern("latest", "TION|ado", True),
    domain=L.Pattern("domain", "eau|sch", True),
    concept=L.Pattern("concept", "an|en"),
    league=L.Pattern("league", "ción", True),
    live=L.Pattern("live", "und |ment"),
    off_domain=L.Pattern("off", "Le |ing|ieux", True),
    topics=(L.Pattern("standings", "ou"), L.Pattern("schedule", "er"), L.Pattern("team_info", "st"), L.Pattern("roster", "zu")),
)
TEST_OFF_TOPIC = L.Pattern("off_topic", r"[Tt]he [a-z]+")
TEST_NOT_IN_CONTEXT = L.Pattern("not_in_context", r"[Ll]e [a-z]+")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def talks(spark: SparkSession, sf: str) -> DataFrame:
    key = (F.col("conv_id") * 100 + F.col("turn")).alias("answer_id")
    return table(spark, sf, "conversations").select(key, "conv_id", "turn", "role", "text")


def part_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_type").distinct()


TEAM_SQL = """
words AS (SELECT DISTINCT unnest(str_split(p_name, ' ')) AS word, p_type FROM part),
teams AS (SELECT upper(word) AS code, (row_number() OVER (ORDER BY word))::INT AS ord, [word, word[1:2]] AS aliases FROM (SELECT DISTINCT word FROM words)),
alias AS (SELECT code, ord, unnest(aliases) AS alias FROM teams)
"""


def teams(spark: SparkSession, sf: str) -> DataFrame:
    """The words of part names as teams, each also called by its first two letters."""
    from pyspark.sql import Window

    words = part_words(spark, sf).select("word").distinct()
    # A few dozen words: a lexicon of fixed size.
    numbered = words.withColumn("ord", F.row_number().over(Window.orderBy("word")))
    return numbered.select(F.upper("word").alias("code"), "ord", F.array("word", F.substring("word", 1, 2)).alias("aliases"))


GLOSSARY_SQL = "glossary AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS en, split_part(p_name, ' ', 2) AS ko FROM part)"


def glossary(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_name").distinct()
    pair = F.split("p_name", " ")
    return names.select(pair[0].alias("term_en"), pair[1].alias("term_ko"), pair.alias("aliases"))


@R.add(
    "expand_query",
    f"""WITH {GLOSSARY_SQL}, hit AS (SELECT DISTINCT doc_id, en, ko FROM documents, glossary WHERE (length(en) >= 2 AND contains(text, en)) OR contains(text, ko)),
    names AS (SELECT doc_id, unnest([en, ko]) AS t FROM hit), g AS (SELECT doc_id, string_agg(DISTINCT t, ',' ORDER BY t) AS extra FROM names GROUP BY doc_id)
    SELECT doc_id, coalesce(extra, '') AS extra FROM documents LEFT JOIN g USING (doc_id)""",
)
def expand_query(spark, sf):
    return M.expand_query(docs(spark, sf), glossary(spark, sf)).select("doc_id", F.array_join("extra", ",").alias("extra"))


@R.add(
    "match_team",
    f"""WITH {TEAM_SQL}, best AS (SELECT doc_id, code FROM documents JOIN alias ON contains(text, alias) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, ord) = 1)
    SELECT doc_id, code AS team FROM documents LEFT JOIN best USING (doc_id)""",
)
def match_team(spark, sf):
    return M.match_team(docs(spark, sf), teams(spark, sf)).select("doc_id", "team")


VENUE_SQL = "venues AS (SELECT DISTINCT substr(word, 1, 3) AS name, p_type AS code FROM words)"


@R.add(
    "match_venue",
    f"""WITH {TEAM_SQL}, {VENUE_SQL}, best AS (SELECT doc_id, name FROM documents JOIN venues ON contains(text, name) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, code, name) = 1)
    SELECT doc_id, name AS venue, (SELECT string_agg(code, ',' ORDER BY code) FROM venues v WHERE v.name = best.name) AS codes FROM documents LEFT JOIN best USING (doc_id)""",
)
def match_venue(spark, sf):
    venues = part_words(spark, sf).select(F.substring("word", 1, 3).alias("name"), F.col("p_type").alias("code")).distinct()
    out = M.match_venue(docs(spark, sf), venues)
    return out.select("doc_id", "venue", F.array_join("venue_codes", ",").alias("codes"))


ITEM_SQL = f"""{GLOSSARY_SQL}, items AS (SELECT row_number() OVER (ORDER BY en, ko) AS ord, concat(en, '-', ko) AS id, concat('(?i)', en, '\\s*', ko, '|', substr(ko, 1, 3), ' ') AS rx FROM glossary)"""


@R.add(
    "match_keywords",
    f"""WITH {ITEM_SQL}, hit AS (SELECT doc_id, id, ord FROM documents, items WHERE regexp_matches(text, replace(rx, substr(rx, -1), '\\s*')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 6)
    SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY ord), '') AS items FROM documents LEFT JOIN hit USING (doc_id) GROUP BY doc_id""",
)
def match_keywords(spark, sf):
    from pyspark.sql import Window

    items = glossary(spark, sf).select(
        F.row_number().over(Window.orderBy("term_en", "term_ko")).alias("ord"), F.concat_ws("-", "term_en", "term_ko").alias("id"),
        F.array(F.concat_ws(" ", "term_en", "term_ko"), F.concat(F.substring("term_ko", 1, 3), F.lit(" "))).alias("keywords"),
    )
    return M.match_keywords(docs(spark, sf), items).select("doc_id", F.array_join("items", ",").alias("items"))


TOPIC_SQL = "array_to_string(list_slice(list_filter(['standings','schedule','team_info','roster'], lambda t: (t = 'standings' AND contains(text, 'ou')) OR (t = 'schedule' AND contains(text, 'er')) OR (t = 'team_info' AND contains(text, 'st')) OR (t = 'roster' AND contains(text, 'zu'))), 1, 2), ',')"
TAG_SQL = f"""{TEAM_SQL}, talk AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, turn, text FROM conversations),
hit AS (SELECT answer_id, code, max(length(alias)) AS n, min(ord) AS o FROM talk JOIN alias ON contains(upper(text), upper(alias)) GROUP BY ALL),
tags AS (SELECT answer_id, text, {TOPIC_SQL} AS topics, coalesce((SELECT string_agg(code, ',' ORDER BY n DESC, o) FROM hit WHERE hit.answer_id = talk.answer_id), '') AS teams FROM talk)"""


def tagged(spark, sf) -> DataFrame:
    return M.tag_topics_teams(talks(spark, sf), teams(spark, sf), topics=TEST_LEXICON.topics)


@R.add("topics_teams", f"WITH {TAG_SQL} SELECT answer_id, topics, teams FROM tags")
def topics_teams(spark, sf):
    return tagged(spark, sf).select("answer_id", F.array_join("topics", ",").alias("topics"), F.array_join("teams", ",").alias("teams"))


@R.add(
    "route",
    f"""WITH {TAG_SQL}, f AS (SELECT *, topics <> '' AND teams <> '' AS data, regexp_matches(text, 'the |with') AS rule_hit, regexp_matches(text, '(?i)TION|ado') AS l,
      regexp_matches(text, '(?i)eau|sch') AS domain_hit FROM tags)
    SELECT answer_id, rule_hit, l OR data AS latest_hit, domain_hit, CASE WHEN data THEN 'latest' WHEN rule_hit AND l THEN 'mixed' WHEN l THEN 'latest' ELSE 'rule' END AS route,
      CASE WHEN data OR rule_hit OR l OR domain_hit THEN 'keyword' ELSE 'default' END AS routed_by FROM f""",
)
def route(spark, sf):
    return K.route_queries(tagged(spark, sf), lexicon=TEST_LEXICON).select(
        "answer_id", "rule_hit", "latest_hit", "domain_hit", "route", "routed_by"
    )


@R.add(
    "scope",
    rf"""WITH n AS (SELECT DISTINCT lower(word) AS name FROM (SELECT unnest(str_split(p_name, ' ')) AS word FROM part)),
    t AS (SELECT conv_id * 100 + turn AS answer_id, text, regexp_matches(text, '(?i)Le |ing|ieux') AS off, regexp_replace(text, '(?i)Le |ing|ieux', ' ', 'g') AS m,
      len({sql_rule_numbers('text')}) > 0 AS numbered FROM conversations),
    f AS (SELECT *, [regexp_extract(m, '(?i)eau|sch'), regexp_extract(m, 'the |with'), regexp_extract(m, 'an|en'), regexp_extract(m, '(?i)ción'), regexp_extract(m, 'und |ment')] AS firsts,
      regexp_matches(m, 'ou|er|st|zu') AS topic, (SELECT bool_or(contains(lower(m), name)) FROM n) AS named FROM t),
    g AS (SELECT *, topic OR len(list_filter(firsts, lambda x: x <> '')) > 0 AS any_hit, topic OR len(list_filter(firsts, lambda x: x <> '' AND NOT regexp_full_match(trim(x), 'an|en'))) > 0 AS strong FROM f)
    SELECT answer_id, CASE WHEN numbered THEN 'rule_no' WHEN strong OR (NOT any_hit AND named) THEN 'lexicon' WHEN off THEN 'negative' WHEN any_hit THEN 'lexicon' ELSE 'default' END AS scope_by,
      CASE WHEN scope_by = 'negative' THEN 'out_of_scope' ELSE 'in_scope' END AS scope FROM g""",
)
def scope(spark, sf):
    names = part_words(spark, sf).select("word")
    return K.scope_queries(talks(spark, sf), lexicon=TEST_LEXICON, names=names).select("answer_id", "scope", "scope_by")


NOISE_SQL = r"""[\s"''“”‘’.。!?,\-–—*_`>#:()\[\]]+"""


@R.add(
    "answer_status",
    rf"""WITH t AS (SELECT conv_id * 100 + turn AS answer_id, text FROM conversations),
    s AS (SELECT *, regexp_matches(text, '[Tt]he [a-z]+') AS o, regexp_matches(text, '[Ll]e [a-z]+') AS c,
      length(regexp_replace(regexp_replace(text, '[Tt]he [a-z]+', '', 'g'), '{NOISE_SQL}', '', 'g')) AS ro,
      length(regexp_replace(regexp_replace(text, '[Ll]e [a-z]+', '', 'g'), '{NOISE_SQL}', '', 'g')) AS rc FROM t)
    SELECT answer_id, CASE WHEN trim(text) = '' THEN 'not_in_rulebook' WHEN o THEN CASE WHEN ro <= 120 THEN 'out_of_scope' ELSE 'answered' END
      WHEN c THEN CASE WHEN rc <= 120 THEN 'not_in_rulebook' ELSE 'answered' END ELSE 'answered' END AS status, status = 'answered' AND (o OR c) AS partial FROM s""",
)
def answer_status(spark, sf):
    patterns = {"off_topic": TEST_OFF_TOPIC, "not_in_context": TEST_NOT_IN_CONTEXT}
    rows = talks(spark, sf).withColumn("status", K.answer_status(X.nfkc(F.col("text")), tail_chars=120, **patterns))
    return rows.select("answer_id", "status", K.partial_refusal(F.col("status"), F.col("text"), **patterns).alias("partial"))


@R.add(
    "name_lexicon",
    "SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT p_name FROM part UNION SELECT c_name FROM customer) WHERE length(name) >= 2",
)
def name_lexicon(spark, sf):
    return M.name_lexicon(
        table(spark, sf, "nation").select("n_name"), table(spark, sf, "part").select("p_name"), table(spark, sf, "customer").select("c_name")
    )


@R.add(
    "rule_numbers",
    f"SELECT doc_id, array_to_string({sql_rule_numbers(chr(39).join(['concat(text, ', ' 5.09, 3.141592 ', ', 1 + doc_id % 9, ', '.', ', 10 + doc_id % 90)']))}, ',') AS numbers FROM documents",
)
def rule_numbers(spark, sf):
    d = F.col("doc_id")
    text = F.concat("text", F.lit(" 5.09, 3.141592 "), (1 + d % 9).cast("string"), F.lit("."), (10 + d % 90).cast("string"))
    return docs(spark, sf).select("doc_id", F.array_join(X.rule_numbers(text), ",").alias("numbers"))


@R.add(
    "rule_ids",
    """SELECT doc_id, concat(1 + doc_id % 9, '.', 10 + doc_id % 90, '(', chr((97 + doc_id % 20)::INT), ')(', 1 + doc_id % 20, ')',
      CASE WHEN doc_id % 20 = 1 THEN '' ELSE '(b)' END) AS rule_id FROM documents""",
)
def rule_ids(spark, sf):
    d = F.col("doc_id")

    def circled(base: int):
        return F.element_at(F.array(*[F.lit(chr(base + i)) for i in range(20)]), (d % 20 + 1).cast("int"))

    raw = F.concat(
        F.lit(" 규칙 "), (1 + d % 9).cast("string"), F.lit("."), (10 + d % 90).cast("string"), circled(0x249C), circled(0x2474), F.lit(" ( b ) (b) ")
    )
    return docs(spark, sf).select("doc_id", X.normalize_rule_id(raw).alias("rule_id"))


CITE_SQL = """
talk AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, turn FROM conversations),
said AS (SELECT answer_id, unnest([conv_id, conv_id + 7]) AS d, unnest([0, 1]) AS pos, unnest(['⒜⑴', '']) AS tail FROM talk),
label AS (SELECT answer_id, pos::INT AS pos, concat(1 + d % 9, '.', 10 + d % 90) AS rule_no, concat('규칙 ', 1 + d % 9, '.', 10 + d % 90, tail) AS label,
  concat(1 + d % 9, '.', 10 + d % 90, CASE WHEN tail <> '' THEN '(a)(1)' ELSE '' END) AS rule_id FROM said),
got AS (SELECT answer_id, j AS rank, 1 + doc_id % 9 || '.' || (10 + doc_id % 90) AS rule_no, doc_id, text, lang FROM
  (SELECT answer_id, conv_id, unnest([0, 1, 2]) AS j FROM talk) JOIN documents ON doc_id = conv_id + j),
first_doc AS (SELECT * FROM got QUALIFY row_number() OVER (PARTITION BY answer_id, rule_no ORDER BY rank) = 1),
first_term AS (SELECT * FROM got QUALIFY row_number() OVER (PARTITION BY answer_id, lang ORDER BY rank) = 1)
"""


def cited(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Messages ending with two rule mentions and a term, and three retrieved documents per message."""
    c = F.col("conv_id")

    def number(d):
        return F.concat((1 + d % 9).cast("string"), F.lit("."), (10 + d % 90).cast("string"))

    text = F.concat(
        F.regexp_replace("text", "[A-Z]{3,}", "x"), F.lit(" see "), number(c), F.lit("⒜⑴, "), number(c + 7), F.lit(" and 3.141592 of TERMX.")
    )
    answers = talks(spark, sf).select("answer_id", "conv_id", text.alias("text"))
    near = answers.select("answer_id", "conv_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("rank"))
    source = docs(spark, sf).withColumnRenamed("text", "content")
    got = near.join(source, near.conv_id + near["rank"] == source.doc_id).select(
        "answer_id", "rank", number(F.col("doc_id")).alias("rule_no"), F.col("doc_id").cast("int").alias("term_no"),
        F.when(F.col("lang") == "en", F.lit("Termx")).alias("term_en"), F.lit("rule").alias("doc_type"),
        (F.col("doc_id") % 50).alias("page_start"), "content",
    )
    return answers, got


SNIP = "substr(replace(trim(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END, concat(' ', chr(10))), chr(10), ' '), 1, 160)"


@R.add(
    "citations",
    f"""WITH {CITE_SQL} SELECT label.answer_id, 0 AS part, pos, label, rule_id, 'rule' AS doc_type, (doc_id % 50)::INT AS page, {SNIP} AS snippet
      FROM label JOIN first_doc USING (answer_id, rule_no)
    UNION ALL SELECT answer_id, 1, 0, concat('용어의 정의 ', doc_id, '. Termx'), concat('DEF-', doc_id), 'term', (doc_id % 50)::INT, {SNIP} FROM first_term WHERE lang = 'en'""",
)
def citations(spark, sf):
    return A.backed_citations(*cited(spark, sf))


@R.add(
    "dropped_citations",
    f"WITH {CITE_SQL} SELECT answer_id, pos, label FROM label WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.answer_id = label.answer_id AND got.rule_no = label.rule_no)",
)
def dropped_citations(spark, sf):
    return A.dropped_citations(*cited(spark, sf))


@R.add(
    "unbacked_refs",
    """WITH c AS (SELECT doc_id, [concat(1 + doc_id % 9, '.', 10 + doc_id % 90), concat(1 + doc_id % 9, '.', 10 + doc_id % 45, '(a)'), concat('DEF-', doc_id % 10)] AS claimed,
      [concat(1 + doc_id % 9, '.', 10 + doc_id % 45), concat('DEF-', doc_id % 7)] AS backing FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(claimed, lambda x: NOT (list_contains(backing, x)
      OR (NOT starts_with(x, 'DEF') AND len(list_filter(backing, lambda b: starts_with(b, x) OR starts_with(x, b))) > 0))))), ',') AS unbacked FROM c""",
)
def unbacked_refs(spark, sf):
    d = F.col("doc_id")

    def no(mod: int, tail: str = ""):
        return F.concat((1 + d % 9).cast("string"), F.lit("."), (10 + d % mod).cast("string"), F.lit(tail))

    claims = table(spark, sf, "documents").select(
        "doc_id", F.array(no(90), no(45, "(a)"), F.concat(F.lit("DEF-"), (d % 10).cast("string"))).alias("claimed"),
        F.array(no(45), F.concat(F.lit("DEF-"), (d % 7).cast("string"))).alias("backing"),
    )
    return A.unbacked_refs(claims).select("doc_id", F.array_join("unbacked", ",").alias("unbacked"))


LINT_SQL = r"""
base AS (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents),
doc AS (SELECT doc_id, ['term_rule', 'situation', 'latest'][1 + (doc_id % 3)::INT] AS kind, l[1] AS head, list_slice(l, 2, len(l)) AS pts FROM base),
t AS (SELECT *, list_concat([head, head], pts, list_transform(pts, lambda p: substr(p, 1, 8))) AS texts, trim(head) AS h FROM doc),
c AS (SELECT doc_id, list_filter([CASE WHEN h = '' THEN 'EMPTY_HEADLINE' END, CASE WHEN h <> '' AND length(h) < 10 THEN 'SHORT_HEADLINE' END,
  CASE WHEN len(list_filter(texts, lambda x: regexp_matches(x, '(?m)^\s*[#>*+]|^\s*-\s|\||<\w+|\$'))) > 0 THEN 'MARKDOWN_INJECTION' END,
  CASE WHEN len(list_filter(pts, lambda p: length(trim(p)) < 8 OR trim(p) = trim(substr(p, 1, 8)))) > 0 THEN 'STUB_SECTION' END,
  CASE WHEN kind = 'term_rule' AND (len(pts) < 2 OR len(pts) > 5) THEN 'BULLET_COUNT' END, 'UNBACKED_RULE_REF', CASE WHEN kind = 'situation' THEN 'KIND_FIELD_MISMATCH' END,
  CASE WHEN kind = 'latest' THEN 'LATEST_NO_AS_OF' END, CASE WHEN h <> '' THEN 'DUP_TEXT' END,
  CASE WHEN list_sum(list_transform(texts, lambda x: length(x))) > 2500 THEN 'TOO_LONG' END], lambda x: x IS NOT NULL) AS codes FROM t)
"""


@R.add(
    "lint",
    f"""WITH {LINT_SQL} SELECT doc_id, array_to_string(codes, ',') AS codes, list_contains(codes, 'EMPTY_HEADLINE') AS blocked,
    CASE WHEN list_contains(codes, 'EMPTY_HEADLINE') THEN 'not_in_context' ELSE 'none' END AS refusal_after FROM c""",
)
def lint(spark, sf):
    """Documents read as answers: first line the headline, other lines the points."""
    lines = F.split("text", "\n")
    null = F.lit(None).cast("string")
    point = F.transform(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 8).alias("label"), t.alias("detail"), F.lit("5.09").alias("rule_ref"))
    )
    none = F.array()
    doc = F.struct(
        F.when(F.col("doc_id") % 3 == 0, F.lit("term_rule")).when(F.col("doc_id") % 3 == 1, F.lit("situation")).otherwise(F.lit("latest")).alias("kind"),
        F.lit(True).alias("answerable"), F.lit("none").alias("refusal"), lines[0].alias("headline"), lines[0].alias("definition"),
        null.alias("ruling"), null.alias("outcome"), point.alias("points"), none.cast(A.POINT).alias("variations"),
        none.cast("array<struct<label:string,value:string,as_of:string>>").alias("facts"), null.alias("example"), null.alias("why"),
        none.cast("array<string>").alias("extra_notes"), none.cast("array<string>").alias("caveats"), F.array(F.lit("DEF-3")).alias("evidence"),
        null.alias("as_of"),
        none.cast(f"array<struct<question:string,kind:string,headline:string,points:{A.POINT},evidence:array<string>>>").alias("sub_answers"),
    )
    rows = docs(spark, sf).select("doc_id", doc.alias("doc"), F.array(F.lit("5.09(a)")).alias("backing"), F.lit(False).alias("knowledge_only"))
    return A.lint_answers(rows).select("doc_id", F.array_join("codes", ",").alias("codes"), "blocked", "refusal_after")


GATE_SQL = """
g AS (SELECT conv_id * 100 + turn AS answer_id, text, ['rule', 'latest', 'mixed'][1 + (conv_id % 3)::INT] AS route, turn % 2 = 0 AS rule_hit, conv_id % 4 = 0 AS abstain, conv_id % 3 AS n_docs,
  turn % 3 AS n_latest, CASE WHEN conv_id % 5 = 0 THEN ['live'] WHEN conv_id % 5 = 1 THEN ['stale'] ELSE [] END AS league, turn % 4 = 1 AS tools, conv_id % 2 = 0 AS know, conv_id, turn,
  regexp_matches(text, 'und |ment') AS live_hit FROM conversations),
g1 AS (SELECT *, len(league) > 0 OR n_latest > 0 AS has, CASE WHEN (len(league) > 0 OR n_latest > 0) AND route = 'latest' AND NOT rule_hit THEN 0 WHEN abstain THEN 0 ELSE n_docs END AS docs_kept FROM g),
g2 AS (SELECT *, docs_kept = 0 AND NOT has AND live_hit AS needs_live, docs_kept = 0 AND NOT has AS nothing FROM g1),
g3 AS (SELECT *, nothing AND (tools OR (know AND NOT needs_live)) AS knowledge_only FROM g2),
g4 AS (SELECT *, CASE WHEN knowledge_only THEN 'model' WHEN league = ['live'] THEN 'live' WHEN has THEN 'snapshot' ELSE 'static' END AS freshness,
  CASE WHEN nothing AND NOT knowledge_only THEN CASE WHEN route IN ('latest', 'mixed') AND needs_live THEN 'phase2_pending' ELSE 'not_in_rulebook' END END AS gate FROM g3)
"""


def gated(spark, sf) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    route_of = F.element_at(F.array(F.lit("rule"), F.lit("latest"), F.lit("mixed")), (c % 3 + 1).cast("int"))
    turns = talks(spark, sf).select(
        "answer_id", "conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("answer"), route_of.alias("route"), (t % 2 == 0).alias("rule_hit"),
        (c % 4 == 0).alias("abstain"), (c % 3).alias("n_docs"), (t % 3).alias("n_latest"),
        F.when(c % 5 == 0, F.array(F.lit("live"))).when(c % 5 == 1, F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>")).alias("league_freshness"),
        (t % 4 == 1).alias("tools_available"), (c % 2 == 0).alias("knowledge_enabled"),
    )
    return A.prepare_gate(turns, live=TEST_LEXICON.live)


@R.add("grounding_gate", f"WITH {GATE_SQL} SELECT answer_id, docs_kept, needs_live, knowledge_only, freshness, gate FROM g4")
def grounding_gate(spark, sf):
    return gated(spark, sf).select("answer_id", "docs_kept", "needs_live", "knowledge_only", "freshness", "gate")


@R.add(
    "finished_turns",
    f"""WITH {GATE_SQL}, h AS (SELECT *, turn % 2 AS n_calls, turn % 2 * (conv_id % 2) AS n_tools, conv_id % 2 AS n_live, turn % 3 AS n_cites FROM g4 WHERE gate IS NULL),
    h1 AS (SELECT *, needs_live AND n_calls = 0 AS downgraded FROM h)
    SELECT answer_id, downgraded, CASE WHEN downgraded THEN 'phase2_pending' ELSE 'answered' END AS status, NOT (n_cites = 0 AND n_tools > 0) AS keeps_rule_sources,
      NOT downgraded AND ((knowledge_only AND n_tools = 0) OR (docs_kept > 0 AND n_cites = 0 AND n_live = 0 AND n_tools > 0)) AS adds_model_source,
      CASE WHEN downgraded THEN 'static' WHEN n_tools > 0 AND freshness IN ('static', 'model') THEN 'web' ELSE freshness END AS freshness FROM h1""",
)
def finished_turns(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    rows = gated(spark, sf).where(F.col("gate").isNull()).withColumns(
        {"n_tool_calls": t % 2, "n_tool_sources": (t % 2) * (c % 2), "n_live_sources": c % 2, "n_citations": t % 3}
    )
    return A.finish_gate(rows).select("answer_id", "downgraded", "status", "keeps_rule_sources", "adds_model_source", "freshness")


HOST_SQL = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '^m\.', '')"


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")


@R.add("url_host", f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def url_host(spark, sf):
    return pages(spark, sf).select("page_id", V.url_host(F.col("url")).alias("host"))


@R.add(
    "video_ids",
    """SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE substr(md5(url), 1, 11) END AS video_id FROM pages""",
)
def video_ids(spark, sf):
    """Video links made from the page addresses, one shape in four without an id."""
    vid, p = F.substring(F.md5("url"), 1, 11), F.col("page_id") % 4
    link = (
        F.when(p == 0, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), vid))
        .when(p == 1, F.concat(F.lit("https://youtu.be/"), vid, F.lit("?si=x")))
        .when(p == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), vid))
        .otherwise(F.concat(F.lit("https://example.com/watch?v="), vid))
    )
    return pages(spark, sf).select("page_id", V.video_id(link).alias("video_id"))


@R.add("required_fields", "SELECT page_id, url FROM pages WHERE trim(url) <> '' AND trim(regexp_extract(html, '<h1>([^<]*)', 1)) <> ''")
def required_fields(spark, sf):
    rows = pages(spark, sf).withColumn("title", F.regexp_extract("html", "<h1>([^<]*)", 1))
    return P.with_required_fields(rows, "url", "title").select("page_id", "url")


@R.add(
    "dedupe_sources",
    f"SELECT page_id, {HOST_SQL} AS url FROM pages QUALIFY row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) = 1",
)
def dedupe_sources(spark, sf):
    rows = pages(spark, sf).select("page_id", V.url_host(F.col("url")).alias("url"), F.lit("").alias("label"), F.col("page_id").alias("position"))
    return A.dedupe_sources(rows).select("page_id", "url")


@R.add(
    "card_ids",
    """SELECT page_id, substr(sha1(url), 1, 10) AS card_id, CASE WHEN page_id % 10 / 10.0 >= 0.7 THEN 'likely' ELSE 'uncertain' END AS confidence FROM pages""",
)
def card_ids(spark, sf):
    return pages(spark, sf).select("page_id", V.card_id(F.col("url")).alias("card_id"), V.confidence((F.col("page_id") % 10) / 10.0).alias("confidence"))


RESULT_SQL = f"""
res AS (SELECT {HOST_SQL} AS query, page_id % 3 AS attempt, page_id AS position, url, concat('T ', page_id) AS title, html AS content, (page_id * 7 % 10 / 10.0)::DOUBLE AS score FROM pages),
tried AS (SELECT * FROM res WHERE score >= 0.5),
firsts AS (SELECT query, min(attempt) AS attempt FROM tried GROUP BY query)
"""


def web_results(spark, sf) -> DataFrame:
    p = F.col("page_id")
    return pages(spark, sf).select(
        V.url_host(F.col("url")).alias("query"), (p % 3).alias("attempt"), p.alias("position"), "url", F.concat(F.lit("T "), p.cast("string")).alias("title"),
        F.col("html").alias("content"), (p * 7 % 10 / 10.0).alias("score"), F.lit("Mon, 24 Aug 2026 00:00:00 GMT").alias("published_date"),
    )


@R.add("web_attempts", f"WITH {RESULT_SQL} SELECT query, attempt, position FROM tried JOIN firsts USING (query, attempt)")
def web_attempts(spark, sf):
    return P.web_attempts(web_results(spark, sf)).select("query", "attempt", "position")


@R.add(
    "web_entries",
    f"""WITH {RESULT_SQL}, kept AS (SELECT * FROM tried JOIN firsts USING (query, attempt) QUALIFY row_number() OVER (PARTITION BY query ORDER BY position) <= 5)
    SELECT query, 'web' AS kind, concat('웹 검색: ', title) AS label, md5(substr(trim(content), 1, 600)) AS text, '2026-08-24' AS as_of, url AS source_url,
      CASE WHEN score >= 0.7 THEN 'likely' ELSE 'uncertain' END AS confidence, position FROM kept WHERE trim(content) <> ''""",
)
def web_entries(spark, sf):
    found = P.web_attempts(web_results(spark, sf))
    return P.web_entries(found, F.lit("2026-09-15").cast("date")).withColumn("text", F.md5("text"))


@R.add(
    "places",
    f"""WITH {RESULT_SQL}, kept AS (SELECT * FROM res WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY query ORDER BY position) <= 4)
    SELECT query, '맛집 정보 안내' AS label, '2026-09-15' AS as_of, NULL::VARCHAR AS source_url, 'uncertain' AS confidence, -1::BIGINT AS position FROM (SELECT DISTINCT query FROM kept)
    UNION ALL SELECT query, concat('맛집 정보: ', title), '2026-08-24', url, CASE WHEN score >= 0.7 THEN 'likely' ELSE 'uncertain' END, position FROM kept""",
)
def places(spark, sf):
    rows = web_results(spark, sf)
    stadiums = rows.select("query", F.col("query").alias("stadium")).distinct()
    entries, _, _ = P.build_places(rows, stadiums, F.lit("2026-09-15").cast("date"))
    return entries.select("query", "label", "as_of", "source_url", "confidence", "position")


@R.add(
    "assemble_sources",
    """WITH f AS (SELECT DISTINCT conv_id AS turn_id, conv_id % 2 = 0 AS keeps, conv_id % 3 = 0 AS adds FROM conversations),
    tool AS (SELECT conv_id AS turn_id, turn, concat('u', turn % 2) AS url FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = 1)
    SELECT turn_id, kind, label, url, part FROM (SELECT conv_id AS turn_id, 'static' AS kind, concat('r', turn) AS label, NULL::VARCHAR AS url, 0 AS part FROM conversations JOIN f ON f.turn_id = conv_id WHERE role = 'assistant' AND keeps
      UNION ALL SELECT conv_id, 'kbo', concat('l', turn), NULL, 1 FROM conversations WHERE role = 'system' UNION ALL SELECT turn_id, 'web', concat('t', turn), url, 2 FROM tool
      UNION ALL SELECT turn_id, 'model', '모델 일반 지식', NULL, 3 FROM f WHERE adds)""",
)
def assemble_sources(spark, sf):
    c = talks(spark, sf)

    def rows(role, kind, mark, url):
        return c.where(F.col("role") == role).select(
            F.col("conv_id").alias("turn_id"), F.lit(kind).alias("kind"), F.concat(F.lit(mark), F.col("turn").cast("string")).alias("label"), url.alias("url"),
            F.lit(None).cast("string").alias("as_of"), F.lit(None).cast("string").alias("confidence"), F.col("turn").cast("int").alias("position"),
        )

    none = F.lit(None).cast("string")
    k = F.col("conv_id")
    flags = c.select(k.alias("turn_id"), (k % 2 == 0).alias("keeps_rule_sources"), (k % 3 == 0).alias("adds_model_source")).distinct()
    link = F.concat(F.lit("u"), (F.col("turn") % 2).cast("string"))
    out = A.assemble_sources(rows("assistant", "static", "r", none), rows("system", "kbo", "l", none), rows("user", "web", "t", link), flags)
    return out.select("turn_id", "kind", "label", "url", "part")
