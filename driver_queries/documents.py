"""Document queries: lines, noise, sections, units, merging, windows, ids, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import chunks as C
from corvane.operators import maintain as M
from corvane.operators import sections as S
from corvane.sources import lines as N
from driver_queries.base import Registry, sql_words, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# Each document read as a small rule book: short lines become numbered headers, some lines become page
# markers or running headers, and from 70% on there are numbered terms and, near the end, an appendix.
BOOK_SQL = r"""
raw AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS line_no,
  len(str_split(text, chr(10))) AS n FROM documents),
placed AS (SELECT *, (n * 7) // 10 AS cut, length(line) AS w FROM raw),
book AS (SELECT doc_id, (line_no // 3 + 1)::INT AS page_no, line_no::INT AS line_no,
  CASE WHEN line_no = cut THEN '<용어의 정의>'
    WHEN line_no > cut AND line_no = n - 1 AND w % 3 = 0 THEN '<부록 표>'
    WHEN line_no > cut AND (line_no - cut) % 2 = 1 THEN concat((line_no - cut + 1) // 2 + CASE WHEN w % 4 = 0 THEN 1 ELSE 0 END, '. TERM ', chr((65 + w % 26)::INT), ' (', w, ')')
    WHEN line_no % 13 = 4 THEN concat('· ', line_no, ' ·')
    WHEN line_no % 11 = 6 THEN concat('5.06  ', w, 'x')
    WHEN w < 120 THEN concat(least(9, 1 + line_no // 4), '.', lpad((CASE WHEN w % 5 = 0 THEN 0 ELSE (w * 7 + line_no) % 100 END)::VARCHAR, 2, '0'), ' ', line)
    ELSE line END AS line FROM placed)
"""


def book_lines(spark: SparkSession, sf: str) -> DataFrame:
    def rewritten(line, no, n):
        w = F.length(line)
        cut = F.floor(n * 7 / 10)
        since = no - cut
        term = F.concat(
            (F.floor((since + 1) / 2) + F.when(w % 4 == 0, 1).otherwise(0)).cast("string"), F.lit(". TERM "),
            F.char((65 + w % 26).cast("bigint")), F.lit(" ("), w.cast("string"), F.lit(")"),
        )
        number = F.when(w % 5 == 0, 0).otherwise((w * 7 + no) % 100)
        chapter = F.least(F.lit(9), 1 + F.floor(no / 4)).cast("string")
        header = F.concat(chapter, F.lit("."), F.lpad(number.cast("string"), 2, "0"), F.lit(" "), line)
        return (
            F.when(no == cut, F.lit("<용어의 정의>"))
            .when((no > cut) & (no == n - 1) & (w % 3 == 0), F.lit("<부록 표>"))
            .when((no > cut) & (since % 2 == 1), term)
            .when(no % 13 == 4, F.concat(F.lit("· "), no.cast("string"), F.lit(" ·")))
            .when(no % 11 == 6, F.concat(F.lit("5.06  "), w.cast("string"), F.lit("x")))
            .when(w < 120, header)
            .otherwise(line)
        )

    # The whole text is rewritten inside its row, so splitting happens once per document.
    split = F.array(F.split("text", "\n"))
    lines = F.flatten(F.transform(split, lambda ls: F.transform(ls, lambda x, i: rewritten(x, i, F.size(ls)))))
    rows = docs(spark, sf).select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return rows.select("doc_id", (F.floor(F.col("line_no") / 3) + 1).cast("int").alias("page_no"), "line_no", "line")


KEPT_SQL = r"""
kind AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*[․·.]\s*\d+\s*[․·.]\s*$') THEN 'marker'
  WHEN regexp_matches(line, '^\d\.\d{2}(~\d\.\d{2})?\s{2,}\S') OR regexp_matches(line, '^\S.*\s{2,}\d\.\d{2}(~\d\.\d{2})?\s*$') THEN 'header' END AS noise FROM book),
kept AS (SELECT doc_id, page_no, line_no, line FROM kind WHERE noise IS NULL)
"""
ANCHOR = r"^\d\.\d{2} "
HEADED_SQL = r"""
starts AS (SELECT doc_id, coalesce(pages[2], pages[1])::INT AS body_start FROM
  (SELECT doc_id, list_sort(list(DISTINCT page_no)) AS pages FROM kept WHERE regexp_matches(line, '^\d\.\d{2} ') GROUP BY doc_id)),
terms_at AS (SELECT doc_id, min(page_no) AS terms_start FROM kept WHERE starts_with(line, '<용어의 정의>') GROUP BY doc_id)
"""
SECTION_SQL = r"""
zoned AS (SELECT kept.*, CASE WHEN page_no >= body_start AND page_no < terms_start THEN 'rule' WHEN page_no >= terms_start THEN 'term' END AS doc_type
  FROM kept JOIN starts USING (doc_id) JOIN terms_at USING (doc_id)),
open_zone AS (SELECT *, CASE WHEN doc_type = 'rule' AND regexp_matches(line, '^\d\.\d{2} \S') THEN (substr(line, 1, 1) || substr(line, 3, 2))::INT END AS value
  FROM zoned WHERE doc_type IS NOT NULL
  QUALIFY NOT coalesce(bool_or(doc_type = 'term' AND regexp_matches(line, '^<[^>]+>') AND NOT starts_with(line, '<용어의 정의')) OVER (PARTITION BY doc_id, doc_type ORDER BY page_no, line_no), false)),
flags AS (SELECT *, coalesce(value >= coalesce(max(value) OVER (PARTITION BY doc_id, doc_type ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS is_rule,
  doc_type = 'term' AND regexp_matches(line, '^\s*\d{1,3}\.\s*[A-Z][A-Za-z \-''’`/&.]+?\s*\([^)]+\)\s*$') AS is_term FROM open_zone),
numbered AS (SELECT *, sum((is_rule OR is_term)::INT) OVER (PARTITION BY doc_id, doc_type ORDER BY page_no, line_no) AS section_no FROM flags),
titled AS (SELECT *, CASE WHEN is_rule THEN trim(substr(line, 6)) END AS rest FROM numbered WHERE section_no > 0),
body AS (SELECT *, CASE WHEN is_rule AND NOT (length(rest) > 25 OR regexp_matches(rest, '[.,]$') OR regexp_matches(rest, '(니다|한다|된다|이다|는다|있다|없다)$')) THEN rest END AS title FROM titled),
parts AS (SELECT *, CASE WHEN is_rule THEN CASE WHEN title IS NULL THEN rest END WHEN is_term THEN NULL WHEN trim(line) <> '' THEN line END AS kept_line FROM body),
secs AS (SELECT doc_id, doc_type, section_no::BIGINT AS section_no,
  max(CASE WHEN is_rule THEN substr(line, 1, 4) END) AS rule_no, max(CASE WHEN is_rule THEN substr(line, 1, 1) || '.00' END) AS rule_chapter,
  max(title) AS rule_title, max(CASE WHEN is_term THEN regexp_extract(line, '^\s*(\d{1,3})\.', 1)::INT END) AS term_no,
  max(CASE WHEN is_term THEN regexp_extract(line, 'TERM [A-Z]') END) AS term_en, max(CASE WHEN is_term THEN regexp_extract(line, '\(([^)]+)\)', 1) END) AS term_ko,
  min(page_no) FILTER (is_rule OR is_term) AS header_page, min(page_no) FILTER (kept_line IS NOT NULL) AS p0, max(page_no) FILTER (kept_line IS NOT NULL) AS p1,
  count(kept_line) AS n_lines, string_agg(kept_line, chr(10) ORDER BY page_no, line_no) AS txt FROM parts GROUP BY ALL),
sections AS (SELECT *, CASE WHEN n_lines = 0 THEN concat_ws(' ', rule_no, rule_title) ELSE txt END AS body_text,
  last_value(CASE WHEN rule_no LIKE '%.00' THEN rule_title END IGNORE NULLS) OVER (PARTITION BY doc_id, doc_type, rule_chapter ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chapter_title
  FROM secs WHERE doc_type = 'rule' OR n_lines > 0)
"""
BOOK = f"WITH RECURSIVE {BOOK_SQL}, {KEPT_SQL}, {HEADED_SQL}, {SECTION_SQL}"


def kept_lines(spark, sf) -> DataFrame:
    return N.strip_noise(book_lines(spark, sf))


def book_sections(spark, sf) -> DataFrame:
    return S.sectionize(kept_lines(spark, sf), body_anchor=ANCHOR)


@R.add("explode_lines", "SELECT doc_id, (generate_subscripts(str_split(text, chr(10)), 1) - 1)::INT AS line_no, unnest(str_split(text, chr(10))) AS line FROM documents")
def explode_lines(spark, sf):
    return N.explode_lines(docs(spark, sf), "doc_id")


@R.add(
    "strip_noise",
    f"""WITH {BOOK_SQL}, {KEPT_SQL} SELECT doc_id, count(*) FILTER (noise = 'marker') AS markers_stripped,
    count(*) FILTER (noise = 'header') AS running_headers_stripped, count(*) FILTER (noise IS NULL) AS lines_kept FROM kind GROUP BY doc_id""",
)
def strip_noise(spark, sf):
    return N.noise_counts(book_lines(spark, sf), "doc_id")


@R.add(
    "short_pages",
    f"""WITH {BOOK_SQL}, {KEPT_SQL} SELECT doc_id, page_no, length(trim(coalesce(string_agg(line, '' ORDER BY line_no) FILTER (noise IS NULL), '')))::INT AS kept_chars
    FROM kind GROUP BY doc_id, page_no HAVING kept_chars < 50""",
)
def short_pages(spark, sf):
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    pages = book_lines(spark, sf).groupBy("doc_id", "page_no").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text")
    )
    return N.short_pages(pages, "doc_id", "page_no")


@R.add("body_start", f"WITH {BOOK_SQL}, {KEPT_SQL}, {HEADED_SQL} SELECT doc_id, body_start FROM starts")
def body_start(spark, sf):
    return S.find_body_start(kept_lines(spark, sf), ANCHOR)


@R.add(
    "accept_headers",
    rf"""WITH {BOOK_SQL}, {KEPT_SQL}, v AS (SELECT *, CASE WHEN regexp_matches(line, '^\d\.\d{{2}} \S') THEN (substr(line, 1, 1) || substr(line, 3, 2))::INT END AS value FROM kept)
    SELECT doc_id, page_no, line_no, value, coalesce(value >= coalesce(max(value) OVER (PARTITION BY doc_id ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS accepted FROM v""",
)
def accept_headers(spark, sf):
    return S.accept_headers(kept_lines(spark, sf)).drop("line")


@R.add(
    "sectionize",
    f"""{BOOK} SELECT doc_id, doc_type, section_no, rule_no, rule_chapter, rule_title, chapter_title, term_no, coalesce(p0, header_page)::INT AS page_start,
    coalesce(p1, header_page)::INT AS page_end, md5(body_text) AS body FROM sections""",
)
def sectionize(spark, sf):
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return book_sections(spark, sf).select(
        "doc_id", "doc_type", "section_no", "rule_no", "rule_chapter", "rule_title", "chapter_title", "term_no", "page_start", "page_end", F.md5(text).alias("body")
    )


@R.add(
    "term_gaps",
    f"{BOOK} SELECT doc_id, term_no, row_number() OVER (PARTITION BY doc_id ORDER BY section_no)::INT AS expected FROM sections WHERE doc_type = 'term' QUALIFY term_no <> expected",
)
def term_gaps(spark, sf):
    return S.term_gaps(book_sections(spark, sf))


@R.add(
    "parse_stats",
    f"""{BOOK}, paged AS (SELECT doc_id, page_no, count(*) FILTER (noise = 'marker') AS m, count(*) FILTER (noise = 'header') AS h, count(*) FILTER (noise IS NULL) AS k,
      length(trim(coalesce(string_agg(line, '' ORDER BY line_no) FILTER (noise IS NULL), ''))) < 50 AS short FROM kind GROUP BY doc_id, page_no),
    pages AS (SELECT doc_id, count(*) AS pages, sum(m)::BIGINT AS markers_stripped, sum(h)::BIGINT AS running_headers_stripped, sum(k)::BIGINT AS lines_kept,
      coalesce(string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (short), '') AS skipped_pages FROM paged GROUP BY doc_id),
    checked AS (SELECT *, (substr(rule_no, 1, 1) || substr(rule_no, 3, 2))::INT AS v, row_number() OVER w AS e,
      max((substr(rule_no, 1, 1) || substr(rule_no, 3, 2))::INT) OVER (PARTITION BY doc_id, doc_type ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM sections WINDOW w AS (PARTITION BY doc_id, doc_type ORDER BY section_no)),
    counts AS (SELECT doc_id, count(*) FILTER (doc_type = 'rule') AS rules, count(*) FILTER (doc_type = 'term') AS terms, bool_and(coalesce(v >= top, true)) AS monotonic,
      string_agg(term_no::VARCHAR, ',' ORDER BY section_no) FILTER (doc_type = 'term' AND term_no <> e) AS term_gaps FROM checked GROUP BY doc_id)
    SELECT doc_id, pages, body_start, markers_stripped, running_headers_stripped, lines_kept, skipped_pages, coalesce(rules, 0) AS rules, coalesce(terms, 0) AS terms,
      coalesce(monotonic, true) AS monotonic, coalesce(term_gaps, '') AS term_gaps
    FROM pages LEFT JOIN starts USING (doc_id) LEFT JOIN counts USING (doc_id)""",
)
def parse_stats(spark, sf):
    def listed(name):
        return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)

    stats = S.parse_stats(book_lines(spark, sf), book_sections(spark, sf), anchor=ANCHOR)
    return stats.select(*[listed(c) if c in ("skipped_pages", "term_gaps") else c for c in stats.columns])


def merge_sql(budget: int, threshold: int) -> str:
    full = f"(m.restart OR walk.used + m.tokens > {budget})"
    return f"""
sized AS (SELECT doc_id, section_no, rule_no, rule_chapter, len({sql_words('body_text')}) AS tokens FROM sections WHERE doc_type = 'rule'),
marked AS (SELECT *, row_number() OVER w AS i, tokens >= {threshold} OR coalesce(lag(tokens >= {threshold}) OVER w, false) OR rule_no LIKE '%.00'
  OR coalesce(lag(rule_chapter) OVER w <> rule_chapter, false) AS restart FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY section_no)),
walk AS (SELECT doc_id, section_no, tokens, i, tokens AS used, 0 AS grp FROM marked WHERE i = 1
  UNION ALL SELECT m.doc_id, m.section_no, m.tokens, m.i, CASE WHEN {full} THEN m.tokens ELSE walk.used + m.tokens END,
    walk.grp + CASE WHEN {full} THEN 1 ELSE 0 END FROM walk JOIN marked m ON m.doc_id = walk.doc_id AND m.i = walk.i + 1)
"""


@R.add("merge_small", f"{BOOK}, {merge_sql(20, 30)} SELECT doc_id, section_no, tokens::INT AS tokens, grp::INT AS merge_group FROM walk")
def merge_small(spark, sf):
    """Small budgets, because the sections here are short."""
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    rules = book_sections(spark, sf).where(F.col("doc_type") == "rule").withColumn("tokens", X.token_count(text))
    return C.merge_small(rules, budget=20, threshold=30).select("doc_id", "section_no", "tokens", "merge_group")


UNIT_SQL = r"""
marks AS (SELECT doc_id, line_no AS pos, CASE w % 7 WHEN 0 THEN concat(chr((9372 + w % 5)::INT), ' ', line) WHEN 1 THEN concat(chr((9332 + w % 4)::INT), ' ', line)
  WHEN 2 THEN concat('(', chr((65 + w % 3)::INT), ') ', line) WHEN 3 THEN concat('[주] ', line) ELSE line END AS line FROM placed),
lv AS (SELECT *, nullif(regexp_extract(line, '^\s*([⒜-⒵])', 1), '') AS a, nullif(regexp_extract(line, '^\s*([⑴-⒇])', 1), '') AS b,
  nullif(regexp_extract(line, '^\s*\(([A-Z])\)', 1), '') AS u, nullif(regexp_extract(line, '^\s*\[(주|원주|부기|문|답)\]', 1), '') AS note FROM marks),
g AS (SELECT *, sum((a IS NOT NULL OR b IS NOT NULL OR u IS NOT NULL)::INT) OVER w AS unit_no, sum((a IS NOT NULL)::INT) OVER w AS ga,
  sum((a IS NOT NULL OR b IS NOT NULL)::INT) OVER w AS gb FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sa,
  last_value(b IGNORE NULLS) OVER (PARTITION BY doc_id, ga ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sb,
  last_value(u IGNORE NULLS) OVER (PARTITION BY doc_id, gb ORDER BY pos ROWS UNBOUNDED PRECEDING) AS su FROM g),
units AS (SELECT doc_id, unit_no::BIGINT AS unit_no, nullif(concat(max(sa), max(sb), '(' || max(su) || ')'), '') AS sub_item,
  concat('(' || chr(ascii(max(sa)) - 9372 + 97) || ')', '(' || (unicode(max(sb)) - 9332 + 1) || ')', '(' || max(su) || ')') AS suffix,
  arg_min(note, pos) FILTER (note IS NOT NULL) AS annotation, count(*) AS n_lines FROM st GROUP BY doc_id, unit_no)
"""


@R.add(
    "split_units",
    f"WITH {BOOK_SQL}, {UNIT_SQL} SELECT * FROM units".replace("ascii(", "unicode("),
)
def split_units(spark, sf):
    w = F.length("line")
    base = F.col("line")
    marked = (
        F.when(w % 7 == 0, F.concat(F.element_at(F.array(*[F.lit(chr(9372 + i)) for i in range(5)]), (w % 5 + 1).cast("int")), F.lit(" "), base))
        .when(w % 7 == 1, F.concat(F.element_at(F.array(*[F.lit(chr(9332 + i)) for i in range(4)]), (w % 4 + 1).cast("int")), F.lit(" "), base))
        .when(w % 7 == 2, F.concat(F.lit("("), F.char((65 + w % 3).cast("bigint")), F.lit(") "), base))
        .when(w % 7 == 3, F.concat(F.lit("[주] "), base))
        .otherwise(base)
    )
    lines = N.explode_lines(docs(spark, sf), "doc_id").select("doc_id", F.col("line_no").alias("pos"), marked.alias("line"))
    return C.split_units(lines, ["doc_id"]).groupBy("doc_id", "unit_no", "sub_item", "suffix", "annotation").agg(F.count(F.lit(1)).alias("n_lines"))


def cut_sql(source: str, text: str, name: str, size: int = 50, overlap: int = 10) -> str:
    """CTE `{name}`: the rows of a CTE with `piece_no` and `piece`, one row per window of a text column."""
    return rf"""
{name}_p AS (SELECT *, regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS ps FROM {source}),
{name} AS (SELECT * EXCLUDE (ps, s), (row_number() OVER (PARTITION BY doc_id, kind, section_no, unit_piece ORDER BY s) - 1)::INT AS piece_no, rtrim(array_to_string(ps[s + 1:s + {size}], '')) AS piece
  FROM (SELECT *, unnest(generate_series(0, greatest(len(ps) - {overlap + 1}, 0), {size - overlap})) AS s FROM {name}_p WHERE len(ps) > 0))
"""


CHUNK_SQL = rf"""
own AS (SELECT *, regexp_replace(body_text, '^\s+|\s+$', '', 'g') AS body, coalesce(p0, header_page) AS q0, coalesce(p1, header_page) AS q1,
  concat_ws(' ', replace(concat('[', rule_chapter, ' ', coalesce(chapter_title, ''), ']'), '  ', ' '), rule_no, rule_title) AS rule_crumb FROM sections),
terms AS (SELECT doc_id, 1 AS kind, section_no, 0 AS unit_piece, concat('DEF-', term_no) AS rule_id, concat('[용어의 정의] ', term_no, '. ', term_en, ' (', term_ko, ')') AS crumb, body, q0, q1, 0 AS ordinal FROM own WHERE doc_type = 'term'),
small AS (SELECT own.*, grp FROM own JOIN walk USING (doc_id, section_no) WHERE doc_type = 'rule' AND tokens < 120),
merged AS (SELECT doc_id, 2 AS kind, min(section_no) AS section_no, 0 AS unit_piece, CASE WHEN count(*) > 1 THEN concat(arg_min(rule_no, section_no), '~', arg_max(rule_no, section_no)) ELSE min(rule_no) END AS rule_id,
  arg_min(rule_crumb, section_no) AS crumb, regexp_replace(string_agg(body_text, chr(10) ORDER BY section_no), '^\s+|\s+$', '', 'g') AS body, min(q0) AS q0, max(q1) AS q1, 0 AS ordinal FROM small GROUP BY doc_id, grp),
large AS (SELECT doc_id, 2 AS kind, section_no, 0 AS unit_piece, rule_no AS rule_id, rule_crumb AS crumb, body, q0, q1, len({sql_words('body')}) AS n FROM own JOIN walk USING (doc_id, section_no) WHERE doc_type = 'rule' AND tokens >= 120),
big AS (FROM large WHERE n > 120), {cut_sql('big', 'body', 'bigs')},
split AS (SELECT doc_id, kind, section_no, 0 AS unit_piece, rule_id, crumb, body, q0, q1, 0 AS ordinal FROM large WHERE n <= 120
  UNION ALL SELECT doc_id, kind, section_no, piece_no, rule_id, crumb, piece, q0, q0, piece_no FROM bigs),
draft AS (SELECT *, CASE WHEN body = '' THEN crumb ELSE concat(crumb, chr(10), body) END AS content FROM (FROM terms UNION ALL FROM merged UNION ALL FROM split)),
counted AS (SELECT *, len({sql_words('content')}) AS tokens FROM draft),
over_limit AS (FROM counted WHERE tokens > 120), {cut_sql('over_limit', 'body', 'again')},
final AS (SELECT doc_id, kind, section_no, unit_piece, 0 AS re, rule_id, q0, q1, content, ordinal, false AS cut FROM counted WHERE tokens <= 120
  UNION ALL SELECT doc_id, kind, section_no, unit_piece, piece_no, rule_id, q0, q1, concat(crumb, chr(10), piece), 999 + row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY kind, section_no, unit_piece, piece_no), true FROM again)
"""


@R.add(
    "build_chunks",
    f"""{BOOK}, {merge_sql(60, 120)}, {CHUNK_SQL} SELECT doc_id::VARCHAR AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY kind, section_no, unit_piece, re) - 1)::INT AS chunk_index,
    rule_id, q0::INT AS page_start, q1::INT AS page_end, len({sql_words('content')})::INT AS tokens, md5(content) AS content, sha1(concat_ws('|', doc_id, rule_id, ordinal)) AS id FROM final""",
)
def build_chunks(spark, sf):
    return book_chunks(spark, sf).select(
        "document_id", "chunk_index", "rule_id", "page_start", "page_end", "tokens", F.md5("content").alias("content"), "id"
    )


def book_chunks(spark, sf) -> DataFrame:
    return C.build_chunks(book_sections(spark, sf).persist(), budget=60, threshold=120, window=50, overlap=10)


@R.add(
    "build_glossary",
    f"""{BOOK} SELECT doc_id::VARCHAR AS document_id, term_no, term_en, term_ko, concat('DEF-', term_no) AS rule_id, p0::INT AS page,
    array_to_string(list_sort(list_distinct([term_en, concat('Term ', substr(term_en, 6)), term_ko])), '|') AS aliases FROM sections WHERE doc_type = 'term'
    QUALIFY row_number() OVER (PARTITION BY doc_id, term_no ORDER BY section_no) = 1""",
)
def build_glossary(spark, sf):
    return C.build_glossary(book_chunks(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


@R.add("token_counts", f"SELECT doc_id, len({sql_words('text')})::INT AS tokens FROM documents")
def token_counts(spark, sf):
    return docs(spark, sf).select("doc_id", X.token_count(X.nfkc(F.col("text"))).alias("tokens"))


WINDOW_SQL = r"""
cut AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS p FROM documents),
wins AS (SELECT doc_id, p, len(p) AS n, unnest(generate_series(0, greatest(len(p) - 61, 0), 390)) AS start FROM cut),
pieces AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS piece_no, start::INT AS start, least(450, n - start)::INT AS n_tokens,
  rtrim(array_to_string(p[start + 1:start + 450], '')) AS piece FROM wins WHERE n > 0)
"""


@R.add("token_windows", f"WITH {WINDOW_SQL} SELECT doc_id, piece_no, start, n_tokens, md5(piece) AS piece FROM pieces")
def token_windows(spark, sf):
    return C.window_chunks(docs(spark, sf), "doc_id").withColumn("piece", F.md5("piece"))


@R.add(
    "chunk_ids",
    """SELECT doc_id, concat_ws(':', substr(sha256(text), 1, 12), 'struct-v2', 'm', '64') AS index_version,
    concat('rulebook-', substr(sha1(concat_ws(':', substr(sha256(text), 1, 12), 'struct-v2', 'm', '64')), 1, 16)) AS document_id,
    sha1(concat_ws('|', concat_ws(':', substr(sha256(text), 1, 12), 'struct-v2', 'm', '64'), source, n_chars)) AS chunk_id FROM documents""",
)
def chunk_ids(spark, sf):
    version = X.index_version(F.sha2("text", 256), C.CHUNKER_VERSION, "m", 64)
    return docs(spark, sf).select(
        "doc_id", version.alias("index_version"), X.document_id(version).alias("document_id"),
        X.chunk_id(version, F.col("source"), F.col("n_chars")).alias("chunk_id"),
    )


@R.add(
    "chunk_stats",
    f"""WITH {WINDOW_SQL}, t AS (SELECT lang, list_sort(list(n_tokens)) AS s FROM pieces JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, len(s)::BIGINT AS chunks, s[1 + floor(len(s) / 2)::BIGINT] AS p50, s[1 + floor(len(s) * 0.9)::BIGINT] AS p90, s[len(s)] AS max_tokens FROM t""",
)
def chunk_stats(spark, sf):
    rows = C.window_chunks(docs(spark, sf), "doc_id", "lang").select(
        "lang", F.col("n_tokens").alias("tokens"), F.lit("rule").alias("doc_type"), F.lit("1.00~1.05").alias("rule_id")
    )
    return C.chunk_stats(rows, ["lang"]).select("lang", "chunks", "p50", "p90", "max_tokens")


@R.add(
    "ingest_cost",
    f"""WITH {WINDOW_SQL} SELECT source, count(*) AS chunks, sum(n_tokens)::BIGINT AS tokens, ceil(count(*) / 256)::BIGINT AS batches,
    round(sum(n_tokens) / 1e6 * 0.13, 6)::DOUBLE AS cost_usd FROM pieces JOIN documents USING (doc_id) GROUP BY source""",
)
def ingest_cost(spark, sf):
    rows = C.window_chunks(docs(spark, sf), "doc_id", "source").withColumnRenamed("n_tokens", "tokens")
    return C.ingest_cost(rows, "text-embedding-3-large", ["source"])


@R.add("page_span", f"WITH {BOOK_SQL} SELECT doc_id, min(page_no) AS page_start, max(page_no) AS page_end FROM book GROUP BY doc_id")
def page_span(spark, sf):
    return C.page_span(book_lines(spark, sf), "doc_id")


@R.add(
    "merge_pages",
    r"""WITH p AS (SELECT conv_id, string_agg(concat(text, ' '), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5(regexp_replace(regexp_replace(replace(t, chr(10), ' '), ' {2,}', ' ', 'g'), '\.{2,}', '.', 'g')) AS page_content FROM p""",
)
def merge_pages(spark, sf):
    merged = N.merge_pages(table(spark, sf, "conversations"), "conv_id", order="turn")
    return merged.withColumn("page_content", F.md5("page_content"))


@R.add(
    "accepted_titles",
    r"""WITH l AS (SELECT doc_id, (generate_subscripts(str_split(text, chr(10)), 1) - 1)::INT AS line_no, trim(unnest(str_split(text, chr(10)))) AS t FROM documents)
    SELECT doc_id, line_no, t AS title FROM l WHERE t <> '' AND length(t) <= 25 AND NOT regexp_matches(t, '[.,]$')""",
)
def accepted_titles(spark, sf):
    lines = N.explode_lines(docs(spark, sf), "doc_id")
    return lines.select("doc_id", "line_no", S.accepted_title(F.col("line")).alias("title")).where(F.col("title").isNotNull())


@R.add(
    "front_lines",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(source, ': ', lang) WHEN doc_id % 3 = 1 THEN concat(source, ': ', n_chars)
    ELSE concat(source, ': ', n_chars, ' → ', lang) END AS line FROM documents""",
)
def front_lines(spark, sf):
    d = F.col("doc_id")
    cells = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("label"),
        F.when(d % 3 == 0, F.lit("-")).otherwise(F.col("n_chars").cast("string")).alias("before"),
        F.when(d % 3 == 1, F.lit("")).otherwise(F.col("lang")).alias("after"),
    )
    return S.front_lines(cells, "doc_id")


@R.add(
    "breadcrumbs",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('[용어의 정의] ', doc_id, '. ', upper(lang), ' (', source, ')') WHEN 1 THEN '[2026년 공식야구규칙 변경 요약]'
    ELSE concat_ws(' ', concat('[', 1 + doc_id % 9, '.00 ', source, ']'), concat(1 + doc_id % 9, '.05'), CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 4 = 1 THEN '⒜' END) END AS breadcrumb FROM documents""",
)
def breadcrumbs(spark, sf):
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, F.lit("term")).when(d % 3 == 1, F.lit("front")).otherwise(F.lit("rule"))
    chapter = (1 + d % 9).cast("string")
    crumb = X.breadcrumb(
        kind, F.concat(chapter, F.lit(".00")), F.col("source"), F.concat(chapter, F.lit(".05")), F.when(d % 2 == 0, F.col("lang")),
        F.when(d % 4 == 1, F.lit("⒜")), d, F.upper("lang"), F.col("source"),
    )
    return table(spark, sf, "documents").select("doc_id", crumb.alias("breadcrumb"))


@R.add(
    "snippets",
    """SELECT doc_id, substr(replace(trim(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END, concat(' ', chr(10), chr(9), chr(13))), chr(10), ' '), 1, 160) AS snippet FROM documents""",
)
def snippets(spark, sf):
    return docs(spark, sf).select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@R.add(
    "clean_text",
    r"""SELECT doc_id, md5(replace(replace(trim(regexp_replace(regexp_replace(text, '(?m)^[\s>#*\-+|]+', ' ', 'g'), '\s+', ' ', 'g')), '<', '&lt;'), '$', '\$')) AS cleaned FROM documents""",
)
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("cleaned"))


@R.add(
    "unseen_content",
    """WITH k AS (SELECT concat('rules/', sha256(text), '.pdf') AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1),
    s AS (SELECT DISTINCT concat('rules/', sha256(text), '.pdf') AS key FROM documents WHERE lang = 'en')
    SELECT k.key, doc_id, copies, CASE WHEN s.key IS NULL THEN 'uploaded' ELSE 'unchanged' END AS status FROM k LEFT JOIN s ON s.key = k.key""",
)
def unseen_content(spark, sf):
    """English texts count as stored already."""
    all_docs = docs(spark, sf)
    stored = all_docs.where(F.col("lang") == "en").select(M.content_key(F.col("text")).alias("key"))
    return M.append_if_unseen(all_docs, stored, content="text", order="doc_id")


@R.add(
    "orphan_keys",
    """SELECT DISTINCT concat('rules/', sha256(text), '.pdf') AS key FROM documents
    WHERE concat('rules/', sha256(text), '.pdf') NOT IN (SELECT concat('rules/', sha256(text), '.pdf') FROM documents WHERE lang = 'en')""",
)
def orphan_keys(spark, sf):
    keyed = docs(spark, sf).select("lang", M.content_key(F.col("text")).alias("key"))
    return M.orphan_keys(keyed.select("key").distinct(), keyed.where(F.col("lang") == "en").select("key"))
