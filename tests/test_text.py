"""Column functions against Python's own rules and known values."""

import sys
import unicodedata

from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import text as X
from corvane.functions import values as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


def test_stable_characters_do_not_change(spark):
    rows = spark.createDataFrame([(chr(i),) for i in range(1, sys.maxunicode) if not 0xD800 <= i < 0xE000], "c string")
    stable = [r.c for r in rows.where(F.col("c").rlike(X.STABLE)).collect()]
    assert len(stable) > 30000
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)


def test_nfkc(spark):
    for text in ("ａｂｃ ５.０９", "é", "한글", "⒜⑴", "plain", "½ ﬁ", None):
        want = None if text is None else unicodedata.normalize("NFKC", text)
        assert one(spark, text, X.nfkc) == want


def test_rule_numbers(spark):
    assert one(spark, "규칙 5.09와 9.13, 3.141592 그리고 15.09 x5.10", X.rule_numbers) == ["5.09", "9.13", "5.10"]


def test_tokens_keep_short_latin_only(spark):
    assert one(spark, "A 가 나다 7 x.", X.tokens) == ["a", "나다", "7", "x"]
    assert one(spark, None, X.tokens) == []


def test_normalize_rule_id(spark):
    cases = {
        "규칙 5.09⒜⑴": "5.09(a)(1)", "5.09 (a)(1)": "5.09(a)(1)", "5.09⒜ (a) (b)": "5.09(a)(b)", " 보크 ": "보크", "6.01(A)": "6.01(A)",
        "5.09⒵⒇": "5.09(z)(20)",
    }
    for raw, want in cases.items():
        assert one(spark, raw, X.normalize_rule_id) == want


def test_body_snippet_and_clean(spark):
    assert one(spark, "head\nbody\nmore", X.body) == "body\nmore"
    assert one(spark, "only", X.body) == "only"
    assert one(spark, "h\n  a\nb  ", lambda c: X.snippet(c, 3)) == "a b"
    assert one(spark, "# Title\r\n- item  <b> $5", X.clean_text) == r"Title item &lt;b> \$5"
    assert one(spark, "INFIELD FLY O'BRIEN", X.title_case) == "INFIELD FLY O'BRIEN".title()


def test_token_windows_cover_every_token_and_keep_the_text(spark):
    text = " ".join(f"w{i}," for i in range(1000))
    windows = one(spark, text, lambda c: X.token_windows(c, 450, 60))
    assert [w.start for w in windows] == [0, 390, 780]
    assert all(w.n_tokens <= 450 for w in windows) and windows[-1].piece.endswith("w999,")
    assert windows[1].piece.startswith("w390,") and windows[0].piece in text
    assert one(spark, "", lambda c: X.token_windows(c, 450, 60)) == []
    assert len(one(spark, "a b c", lambda c: X.token_windows(c, 450, 60))) == 1


def test_innings_and_durations(spark):
    cases = {"138 2/3": 138.667, "7": 7.0, "1/3": 0.333, "": None, "x": None, "12/3": 1.667, "5 1/0": 5.0}
    for raw, want in cases.items():
        assert one(spark, raw, V.parse_innings) == want
    for iso, want in {"PT12M41S": 761, "PT1H": 3600, "P1DT2S": 86402, "P1D": None, "12:41": None}.items():
        assert one(spark, iso, V.parse_duration) == want
    for seconds, want in {761: "12:41", 3661: "1:01:01", 5: "0:05", None: None}.items():
        assert one(spark, seconds, V.format_duration, "int") == want


def test_kst_day_boundary(spark):
    cases = {
        "2026-09-16T15:00:00Z": "2026-09-17", "2026-09-16T14:59:59Z": "2026-09-16", "2026-09-16T15:30:00": "2026-09-17",
        "2026-09-17T00:30:00+09:00": "2026-09-17", "soon": None,
    }
    for raw, want in cases.items():
        got = one(spark, raw, V.kst_date)
        assert (got.isoformat() if got else None) == want


def test_published_as_of(spark):
    today = F.lit("2026-09-15").cast("date")
    for raw, want in {"2026-08-24T01:00:00Z": "2026-08-24", "Mon, 24 Aug 2026 00:00:00 GMT": "2026-08-24", "": "2026-09-15", "x": "2026-09-15"}.items():
        assert one(spark, raw, lambda c: V.published_as_of(c, today)) == want


def test_video_ids(spark):
    vid = "abcdefghijk"
    cases = {
        f"https://www.youtube.com/watch?v={vid}&t=1": vid, f"https://youtu.be/{vid}?x": vid, f"https://m.youtube.com/shorts/{vid}": vid,
        f"https://music.youtube.com/watch?v={vid}": vid, f"https://example.com/watch?v={vid}": None, "https://youtu.be/short": None, "nope": None,
        f"https://youtube.com/live/{vid}/x": vid,
    }
    for url, want in cases.items():
        assert one(spark, url, V.video_id) == want
    assert one(spark, "UC" + "a" * 22, V.uploads_playlist_id) == "UU" + "a" * 22
    assert one(spark, "UCshort", V.uploads_playlist_id) is None


def test_abstain_truth_table(spark):
    rows = [
        (True, False, 0.0, 0.0, False), (False, False, 0.1, 0.01, True), (False, False, 0.4, 0.01, False),
        (False, False, 0.1, 0.2, False), (False, True, 0.0, 0.01, False), (False, True, 0.0, 0.2, False),
    ]
    df = spark.createDataFrame(rows, "e boolean, f boolean, d double, r double, want boolean")
    got = df.select(V.should_abstain(F.col("e"), F.col("f"), F.col("d"), F.col("r")).alias("g"), "want")
    assert all(r.g == r.want for r in got.collect())
    opted = df.select(V.should_abstain(F.col("e"), F.col("f"), F.col("d"), F.col("r"), on_dense_failure=True).alias("g"))
    assert [r.g for r in opted.collect()] == [False, True, False, False, True, False]


def test_default_lexicon(spark):
    def labels(text):
        patterns = (L.RULE, L.LEAGUE, L.LIVE, L.DOMAIN, L.OFF_DOMAIN)
        return one(spark, text, lambda c: L.hits(c, patterns))

    assert labels("인필드 플라이가 뭐야?") == ["rule"]
    assert labels("LG 다음 경기 일정") == ["live"]
    assert labels("비디오 판독 몇 번?") == ["league"]
    assert labels("kbo 날씨") == ["domain", "off"]
    assert one(spark, "9월 중 순위", lambda c: L.hits(c, L.TOPICS)) == ["standings"]


def test_game_line_avoids_rule_numbers(spark):
    df = spark.sql("select timestamp_ntz'2026-09-13 18:30:00' t").select(
        V.game_line(F.lit("last_finished"), F.col("t"), F.lit("LG"), F.lit("삼성"), F.lit("잠실"), F.lit("RESULT"), F.lit(3), F.lit(2)).alias("a"),
        V.game_line(F.lit("upcoming"), F.col("t"), F.lit("LG"), F.lit("삼성"), F.lit(None).cast("string"), F.lit("BEFORE"), F.lit(0), F.lit(0)).alias("b"),
    )
    row = df.first()
    assert row.a == "9월 13일 LG 대 삼성 3-2 (잠실)" and row.b == "9월 13일 18:30 LG 대 삼성 (구장 미정)"


def test_a_shown_duration_is_parsed_once(spark):
    df = spark.createDataFrame([("P1DT2H3M4S",), ("PT5S",), ("x",), (None,)], "iso string")
    shown = df.select(V.format_duration(V.parse_duration(F.col("iso"))).alias("s"))
    assert [r.s for r in shown.collect()] == ["26:03:04", "0:05", None, None]
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan
