"""Names, routes, scope, citations, answer checks and source lists."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.operators import answers as A
from corvane.operators import classify as K
from corvane.operators import matching as M

TEAMS = [
    ("LG", 0, ["LG", "엘지", "LG 트윈스"], "LG 트윈스", "LG", "서울", "서울종합운동장", "잠실", None), ("OB", 1, ["두산", "베어스"], "두산 베어스", "두산", "서울", "서울종합운동장", "잠실", None),
    ("SS", 2, ["삼성", "라이온즈"], "삼성 라이온즈", "삼성", "대구", "라이온즈 파크", "대구", "포항"), ("NC", 3, ["NC", "엔씨"], "NC 다이노스", "NC", "창원", "NC 파크", "창원", None),
]


def teams(spark):
    schema = "code string, ord int, aliases array<string>, full string, short string, hometown string, stadium string, stadium_short string, stadium_secondary_short string"
    return spark.createDataFrame(TEAMS, schema)


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, text string")


def column(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("qid").collect()]


def test_team_and_venue(spark):
    q = asks(spark, "LG 트윈스와 두산", "잠실 경기", "대구 맛집", "포항 경기", "아무", "삼성 NC")
    found = M.team_or_venue(M.match_venue(M.match_team(q, teams(spark)), M.venue_names(teams(spark))))
    assert column(found, "team", "venue", "venue_codes") == [
        ("LG", None, None), (None, "잠실", ["LG", "OB"]), ("SS", "대구", ["SS"]), ("SS", "포항", ["SS"]), (None, None, None), ("SS", None, None),
    ]


def test_joined_and_inline_lexicons_agree(spark):
    names = spark.createDataFrame([(f"n{i}x", i) for i in range(700)] + [("한화", 700), ("n1x", 701), ("z", 702), ("", 703), (None, 704)], "name string, code int")
    texts = asks(spark, "n1x n12x n699x", "한화 n5 z", "", None, "n1x n12x n699x")
    inline = M.lexicon_hits(texts, "text", names, "name", inline=5000)
    joined = M.lexicon_hits(texts, "text", names, "name", inline=10)

    def codes(df):
        return [sorted(h.code for h in r.found) for r in df.orderBy("qid").collect()]

    assert codes(inline) == codes(joined) == [[1, 12, 699, 701], [700, 702], [], [], [1, 12, 699, 701]]


def test_half_a_million_names(spark):
    names = spark.range(500_000).select(F.concat(F.lit("name"), F.col("id").cast("string"), F.lit(";")).alias("name"), "id")
    found = M.lexicon_hits(asks(spark, "name7; name499999; and name", "none"), "text", names, "name").orderBy("qid").collect()
    assert [sorted(h.id for h in r.found) for r in found] == [[7, 499999], []]


def test_five_thousand_keywords(spark):
    rows = [(i, f"i{i}", [f"key{i}.", f"two  part{i}."]) for i in range(5000)]
    items = spark.createDataFrame(rows, "ord int, id string, keywords array<string>")
    out = M.match_keywords(asks(spark, "KEY4999. twopart3. key3.", "two part7.", "ｋｅｙ８．", "two"), items, limit=2)
    assert column(out, "items") == [(["i3", "i4999"],), (["i7"],), (["i8"],), ([],)]


def test_full_width_text_is_understood(spark):
    q = asks(spark, "ＬＧ 경기")
    assert column(M.match_team(q, teams(spark)), "team") == [("LG",)]


def test_query_expansion_is_case_sensitive(spark):
    glossary = spark.createDataFrame([("BALK", "보크", ["BALK", "Balk", "보크"]), ("OUT", "아웃", ["O", "OUT"])], "term_en string, term_ko string, aliases array<string>")
    out = M.expand_query(asks(spark, "보크가 뭐야", "balk O", "Balk OUT"), glossary)
    assert column(out, "extra") == [(["BALK", "보크"],), ([],), (["BALK", "OUT", "보크", "아웃"],)]


def test_keywords_ignore_case_and_blanks(spark):
    items = spark.createDataFrame([(0, "abs", ["ABS", "자동 투구"]), (1, "clock", ["피치 클락"]), (2, "c++", ["c++ (x)"])], "ord int, id string, keywords array<string>")
    out = M.match_keywords(asks(spark, "abs 존", "자동투구와 피치  클락", "C++   (X)", "없음"), items)
    assert column(out, "items") == [(["abs"],), (["abs", "clock"],), (["c++"],), ([],)]


def test_routes(spark):
    q = asks(spark, "LG 순위 알려줘", "보크 판정", "오늘 경기 판정 규칙", "뉴스", "프로야구", "안녕", "kia 순위", "5.09")
    out = K.route_queries(M.tag_topics_teams(q, teams(spark)))
    assert column(out, "route", "routed_by") == [
        ("latest", "keyword"), ("rule", "keyword"), ("mixed", "keyword"), ("latest", "keyword"), ("rule", "keyword"), ("rule", "default"),
        ("latest", "keyword"), ("rule", "keyword"),
    ]


def test_scope(spark):
    names = spark.createDataFrame([("박해민",), ("Balk",)], "name string")
    q = asks(spark, "9.13 뜻", "야구랑 축구 중 뭐가 재밌어?", "축구 경기 몇 명이서 해?", "리그오브레전드", "몇 명이 해?", "안녕하세요", "박해민", "balk 날씨")
    out = K.scope_queries(q, names=names)
    assert column(out, "scope", "scope_by") == [
        ("in_scope", "rule_no"), ("in_scope", "lexicon"), ("out_of_scope", "negative"), ("out_of_scope", "negative"), ("in_scope", "lexicon"),
        ("in_scope", "default"), ("in_scope", "lexicon"), ("in_scope", "lexicon"),
    ]


def test_answer_status(spark):
    texts = ["", L.OFF_TOPIC_REFUSAL, f"**{L.NOT_IN_CONTEXT_REFUSAL}** 다만 짧게.", L.NOT_IN_CONTEXT_REFUSAL + " 그러나 " + "긴 설명 " * 20, "보크는 반칙이다."]
    q = asks(spark, *texts).withColumn("status", K.answer_status(F.col("text")))
    out = q.withColumn("partial", K.partial_refusal(F.col("status"), F.col("text")))
    assert column(out, "status", "partial") == [
        ("not_in_rulebook", False), ("out_of_scope", False), ("not_in_rulebook", False), ("answered", True), ("answered", False),
    ]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "규칙 5.09⒜⑴과 5.09, 6.01 그리고 3.141592. INFIELD FLY 참고, 5.09⒜⑴")], "answer_id int, text string")
    docs = spark.createDataFrame(
        [(1, 1, "5.09", None, None, "rule", 40, "h\n첫 줄\n둘째"), (1, 2, "5.09", None, None, "rule", 41, "h\n다른"), (1, 3, None, 40, "Infield Fly", "term", 200, "t\n정의")],
        "answer_id int, rank int, rule_no string, term_no int, term_en string, doc_type string, page_start int, content string",
    )
    got = sorted((r.part, r.pos, r.label, r.rule_id, r.page, r.snippet) for r in A.backed_citations(answers, docs).collect())
    assert [g[2:5] for g in got] == [("규칙 5.09⒜⑴", "5.09(a)(1)", 40), ("규칙 5.09", "5.09", 40), ("용어의 정의 40. Infield Fly", "DEF-40", 200)]
    assert got[0][5] == "첫 줄 둘째"
    assert [r.label for r in A.dropped_citations(answers, docs).collect()] == ["규칙 6.01"]


def test_unbacked_prefixes_both_ways(spark):
    rows = [(0, ["5.09(a)", "5.09"], ["5.09"]), (1, ["5.09"], ["5.09(b)"]), (2, ["def-3", "DEF-4"], ["DEF-3"]), (3, ["6.01", "5.1"], ["5.09"])]
    out = A.unbacked_refs(spark.createDataFrame(rows, "qid int, claimed array<string>, backing array<string>"))
    assert column(out, "unbacked") == [([],), ([],), (["DEF-4"],), (["5.1", "6.01"],)]


BASE = {
    "kind": "term_rule", "answerable": True, "refusal": "none", "headline": "보크는 투수의 반칙 동작이다", "definition": "주자를 속이는 동작을 막는 규칙이다.", "ruling": None, "outcome": None,
    "points": [{"label": "조건", "detail": "주자가 있을 때만 적용된다.", "rule_ref": "6.02"}, {"label": "결과", "detail": "주자가 한 베이스씩 나아간다.", "rule_ref": None}],
    "variations": [], "facts": [], "example": None, "why": None, "extra_notes": [], "caveats": [], "evidence": ["6.02", "2026-09-07 기준 출처"], "as_of": None, "sub_answers": [],
}


def lint(spark, knowledge_only=False, backing=("6.02(a)",), **change):
    rows = spark.createDataFrame([Row(payload=json.dumps({**BASE, **change}, ensure_ascii=False))])
    parsed = A.parse_answers(rows)
    assert not parsed.first().bad
    ready = parsed.withColumn("backing", F.array(*[F.lit(b) for b in backing]).cast("array<string>")).withColumn("knowledge_only", F.lit(knowledge_only))
    return A.lint_answers(ready).first()


def test_lint_codes(spark):
    assert lint(spark).codes == []
    assert lint(spark, headline=" ").codes == ["EMPTY_HEADLINE"] and lint(spark, headline=" ").refusal_after == "not_in_context"
    assert lint(spark, headline="9명입니다").codes == ["SHORT_HEADLINE"] and not lint(spark, headline="9명입니다").blocked
    assert lint(spark, why=L.NOT_IN_CONTEXT_REFUSAL).codes == ["REFUSAL_INSIDE_ANSWER"]
    assert lint(spark, example="# 제목").codes == ["MARKDOWN_INJECTION"]
    assert lint(spark, points=BASE["points"][:1]).codes == ["BULLET_COUNT"]
    assert lint(spark, points=[{"label": "a", "detail": "짧다", "rule_ref": None}] * 2).codes == ["STUB_SECTION"]
    assert lint(spark, evidence=["7.01"]).codes == ["UNBACKED_RULE_REF"]
    assert lint(spark, backing=(), evidence=["7.01"]).codes == []
    assert lint(spark, knowledge_only=True, backing=()).codes == ["UNBACKED_RULE_REF"]
    assert lint(spark, kind="situation", ruling="포스 아웃").codes == []
    assert lint(spark, kind="situation").codes == ["KIND_FIELD_MISMATCH"]
    assert lint(spark, ruling="아웃", facts=[{"label": "a", "value": "b", "as_of": None}]).codes == ["KIND_FIELD_MISMATCH"] * 2
    assert lint(spark, kind="latest").codes == ["LATEST_NO_AS_OF"]
    assert lint(spark, definition=BASE["headline"]).codes == ["DUP_TEXT"]
    assert lint(spark, why="가" * 2500).codes == ["TOO_LONG"]
    assert lint(spark, answerable=False, headline="").codes == []
    sub = [{"question": "질문", "kind": "term_rule", "headline": "답", "points": [], "evidence": ["8.88"]}]
    assert lint(spark, sub_answers=sub).codes == ["UNBACKED_RULE_REF"]


def test_strict_answer_parsing(spark):
    bad = [{**BASE, "extra": 1}, {k: v for k, v in BASE.items() if k != "why"}]
    rows = spark.createDataFrame([Row(payload=json.dumps(b)) for b in bad] + [Row(payload="not json")])
    assert all(r.bad and r.doc is None for r in A.parse_answers(rows).collect())


def test_live_question_without_tool_call_is_downgraded(spark):
    row = Row(turn_id=1, answer="오늘 3위다", docs_kept=0, needs_live=True, knowledge_only=True, freshness="model", n_tool_calls=0, n_tool_sources=0, n_live_sources=0, n_citations=0)
    out = A.finish_gate(spark.createDataFrame([row])).first()
    assert out.answer == L.NOT_IN_CONTEXT_REFUSAL and (out.status, out.freshness, out.adds_model_source) == ("phase2_pending", "static", False)


def test_source_assembly(spark):
    schema = "turn_id int, kind string, label string, url string, as_of string, confidence string, position int"

    def rows(*items):
        return spark.createDataFrame([(t, k, lbl, u, "", "", i) for i, (t, k, lbl, u) in enumerate(items)], schema)

    flags = spark.createDataFrame([(1, False, True), (2, True, False)], "turn_id int, keeps_rule_sources boolean, adds_model_source boolean")
    out = A.assemble_sources(
        rows((1, "static", "r1", None), (2, "static", "r2", None)), rows((1, "kbo", "l1", None)),
        rows((1, "web", "t1", "u"), (1, "web", "t2", "u"), (1, "web", "t3", ""), (1, "web", "t3", None)), flags,
    )
    assert sorted((r.turn_id, r.kind, r.label) for r in out.collect()) == [
        (1, "kbo", "l1"), (1, "model", "모델 일반 지식"), (1, "web", "t1"), (1, "web", "t3"), (2, "static", "r2"),
    ]
