"""Lines to sections to chunks, on a small rule book and against loops."""

import random

from pyspark.sql import functions as F

from corvane.operators import chunks as C
from corvane.operators import sections as S
from corvane.plans import ingest as I
from corvane.sources import lines as N

LONG = " ".join(f"단어{i}" for i in range(320))
PAGES = {
    1: "차례\n1.00 경기의 목적\n2.00 경기장",
    7: "2026년 주요 변경\n항목 하나\n\n항목 둘",
    25: "· 25 ·\n1.00 경기의 목적\n경기는 두 팀이 한다.\n1.01 팀 구성\n각 팀은 아홉 명이다.",
    26: "1.01  팀 구성\n1.00 경기의 목적을 다시 말한다\n2.00 경기장\n2.01 경기장의 설정\n넓이를 정한다.",
    27: f"5.09 아웃\n머리말이다.\n⒜ 타자 아웃 {LONG}\n⑴ 뜬공 {LONG}\n[주] 설명\n⑵ 파울 {LONG}\n(A) 세부 {LONG}\n⒝ 주자 아웃 {LONG}",
    28: "5.10 선수의 교체는 언제나 할 수 있는 것이 원칙이라고 한다\n본문이다.",
    30: "<용어의 정의>\n설명 줄\n1. ADJUDGED (어드저지드·판정)\n심판원의 판단이다.\n3. BALK (보크)\n반칙 투구다.",
    31: "4. O'BRIEN-PLAY (플레이)\n<야구 도량형>\n5. AFTER (뒤)\n뒤의 줄",
}


def pages(spark):
    return spark.createDataFrame([("doc", n, t) for n, t in PAGES.items()], "doc_id string, page_no int, text string")


def lines(spark):
    return N.explode_lines(pages(spark), "doc_id", "page_no")


def sections(spark):
    return S.sectionize(N.strip_noise(lines(spark)))


def test_noise_and_short_pages(spark):
    row = N.noise_counts(lines(spark), "doc_id").first()
    assert (row.markers_stripped, row.running_headers_stripped) == (1, 1)
    noise = {"· 25 ·", "1.01  팀 구성"}
    want = {n for n, t in PAGES.items() if len("".join(x for x in t.split("\n") if x not in noise).strip()) < 50}
    assert {r.page_no for r in N.short_pages(pages(spark), "page_no").collect()} == want and 27 not in want and 7 in want


def test_sections(spark):
    got = {(r.doc_type, r.section_no): r for r in sections(spark).collect()}
    rules = [got[k] for k in sorted(got) if k[0] == "rule"]
    assert [r.rule_no for r in rules] == ["1.00", "1.01", "2.00", "2.01", "5.09", "5.10"]
    assert rules[0].chapter_title == "경기의 목적" and rules[1].chapter_title == "경기의 목적"
    # A smaller number later in the text is body text, and a sentence is no title.
    assert [x.line for x in rules[1].lines][-1] == "1.00 경기의 목적을 다시 말한다"
    assert rules[5].rule_title is None and rules[5].lines[0].line.startswith("선수의 교체는")
    assert [(x.page, x.line) for x in rules[2].lines] == [(26, "2.00 경기장")]
    terms = [got[k] for k in sorted(got) if k[0] == "term"]
    assert [(t.term_no, t.term_en, t.term_ko) for t in terms] == [(1, "ADJUDGED", "어드저지드·판정"), (3, "BALK", "보크")]
    stats = S.parse_stats(lines(spark), sections(spark)).first()
    assert (stats.rules, stats.terms, stats.body_start, stats.monotonic) == (6, 2, 25, True)
    assert [(r.term_no, r.expected) for r in S.term_gaps(sections(spark)).collect()] == [(3, 2)]


def test_header_acceptance_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(d, 1, i, f"{rng.randint(1, 9)}.{rng.randint(0, 99):02d} 제목") for d in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, line string")
    got = {(r.doc_id, r.line_no): r.accepted for r in S.accept_headers(df).collect()}
    last = {}
    for d, _, i, line in rows:
        v = float(line[:4])
        ok = v >= last.get(d, -1)
        last[d] = v if ok else last[d]
        assert got[(d, i)] == ok


def test_front_section_table(spark):
    cells = spark.createDataFrame(
        [("doc", 0, "존", "상단", "하단"), ("doc", 1, "시간", "-", "18초"), ("doc", 2, "폭", "2cm", ""), ("doc", 3, "", "x", "y")],
        "doc_id string, row_no int, label string, before string, after string",
    )
    kept = N.strip_noise(lines(spark))
    table = S.front_sections(kept, cells).first()
    assert [x.line for x in table.lines] == ["2026년 공식야구규칙 변경 요약사항", "존: 상단 → 하단", "시간: 18초", "폭: 2cm"]
    plain = S.front_sections(kept).first()
    assert [x.line for x in plain.lines] == ["2026년 주요 변경", "항목 하나", "항목 둘"]


def test_units(spark):
    big = sections(spark).where(F.col("rule_no") == "5.09")
    rows = C.split_units(S.section_lines(big, "doc_id", "section_no"), ["doc_id", "section_no"])
    units = {r.unit_no: r for r in rows.collect()}
    assert [units[i].suffix for i in range(6)] == ["", "(a)", "(a)(1)", "(a)(2)", "(a)(2)(A)", "(b)"]
    assert [units[i].sub_item for i in range(6)] == [None, "⒜", "⒜⑴", "⒜⑵", "⒜⑵(A)", "⒝"]
    assert units[2].annotation == "주" and units[3].annotation is None


def loop_groups(sizes, chapters, numbers, budget, threshold):
    out, group, used, head = [], -1, 0, None
    for n, ch, no in zip(sizes, chapters, numbers):
        large = n >= threshold
        if group < 0 or large or head == "large" or no.endswith(".00") or head != ch or used + n > budget:
            group, used = group + 1, 0
        used += n
        head = "large" if large else ch
        out.append(group)
    return out


def test_merging_equals_the_loop(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for d in range(30):
        n = rng.randint(1, 25)
        numbers = sorted(f"{rng.randint(1, 4)}.{rng.choice([0, 1, 2, 3]):02d}" for _ in range(n))
        sizes = [rng.choice([50, 120, 200, 480, 950]) for _ in range(n)]
        groups = loop_groups(sizes, [x[0] for x in numbers], numbers, 500, 900)
        for i in range(n):
            rows.append((d, i, numbers[i], numbers[i][0] + ".00", sizes[i]))
            want[(d, i)] = groups[i]
    df = spark.createDataFrame(rows, "doc_id int, section_no int, rule_no string, rule_chapter string, tokens int")
    assert {(r.doc_id, r.section_no): r.merge_group for r in C.merge_small(df).collect()} == want


def test_chunks(spark):
    front = S.front_sections(N.strip_noise(lines(spark)))
    both = sections(spark).unionByName(front, allowMissingColumns=True)
    chunks = sorted(C.build_chunks(both).collect(), key=lambda r: r.chunk_index)
    assert [c.chunk_index for c in chunks] == list(range(len(chunks)))
    assert len({c.id for c in chunks}) == len(chunks)
    assert max(c.tokens for c in chunks) <= C.SPLIT_THRESHOLD
    ids = [c.rule_id for c in chunks]
    assert ids[:3] == ["CHG-2026", "DEF-1", "DEF-3"]
    assert ids[3:5] == ["1.00~1.01", "2.00~2.01"]
    assert ids[5:] == ["5.09", "5.09(a)", "5.09(a)(1)", "5.09(a)(2)", "5.09(a)(2)(A)", "5.09(b)", "5.10"]
    a1 = next(c for c in chunks if c.rule_id == "5.09(a)(1)")
    assert a1.parent_id == "5.09" and a1.annotation == "주" and a1.breadcrumb == "[5.00 ] 5.09 아웃 ⒜⑴" and a1.content.startswith(a1.breadcrumb + "\n⑴ 뜬공")
    assert chunks[3].breadcrumb == "[1.00 경기의 목적] 1.00 경기의 목적" and (chunks[3].page_start, chunks[3].page_end) == (25, 26)
    again = {c.id for c in C.build_chunks(both).collect()}
    assert again == {c.id for c in chunks}


def test_oversized_units_and_contents_are_cut(spark):
    chunks = C.build_chunks(sections(spark), budget=60, threshold=100, window=50, overlap=10).collect()
    assert all(c.tokens <= 100 for c in chunks) and len({c.id for c in chunks}) == len(chunks)
    pieces = [c for c in chunks if c.rule_id == "5.09(b)"]
    assert len(pieces) == 8 and all("⒝" == c.sub_item for c in pieces)


def test_glossary(spark):
    got = {r.term_no: r.aliases for r in C.build_glossary(C.build_chunks(sections(spark))).collect()}
    assert got == {1: sorted({"ADJUDGED", "Adjudged", "어드저지드·판정", "어드저지드", "판정"}), 3: sorted({"BALK", "Balk", "보크"})}


def test_chunk_statistics(spark):
    rows = [("rule", "1.00~1.02", 10), ("rule", "1.09~2.01", 30), ("term", "DEF-1", 20), ("front", "CHG-2026", 40)]
    row = C.chunk_stats(spark.createDataFrame(rows, "doc_type string, rule_id string, tokens int")).first()
    assert (row.chunks, row.p50, row.p90, row.max_tokens, row.chapter_crossing) == (4, 30, 40, 40, 1)


def test_merge_pages(spark):
    df = spark.createDataFrame([("f", 2, "c..d....e"), ("f", 1, "a\nb   x")], "source string, page_no int, text string")
    assert N.merge_pages(df, "source").first().page_content == "a b x c.d.e "


def test_ingest_skips_what_is_active_and_gates_the_rest(spark, tmp_path):
    from corvane.sources.files import read_chunks

    source = pages(spark).select(F.lit("book.pdf").alias("source"), "page_no", "text")
    junk = spark.createDataFrame([("junk.pdf", 1, "nothing here")], "source string, page_no int, text string")
    first = I.ingest(source.unionByName(junk), model="m", dims=8)
    assert first.documents.count() == 1 and first.rejected.select("source").first().source == "junk.pdf"
    I.store(first, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/documents")
    chunks = read_chunks(spark, f"{tmp_path}/chunks")
    assert chunks.count() == stored.first().chunk_count and chunks.select("id").distinct().count() == chunks.count()
    assert I.ingest(source, stored, model="m", dims=8).documents.count() == 0
    assert I.ingest(source, stored, model="m", dims=8, force=True).documents.count() == 1
    assert I.ingest(source, stored, model="m", dims=9).documents.count() == 1
