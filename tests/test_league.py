"""Feeds, validation, schedules, rosters, entries, videos and places."""

import datetime as dt
import json

from pyspark.sql import functions as F

from corvane.operators import league as G
from corvane.operators import media as P
from corvane.sources import feeds as FD
from corvane.sources import files as FL

CODES = ["LG", "OB", "SS", "NC", "KT", "HT", "SK", "HH", "LT", "WO"]


def team_row(i, **change):
    wins, losses = 70 - 4 * i, 34 + 4 * i
    row = {
        "teamId": CODES[i], "teamName": f"팀{i}", "teamShortName": CODES[i], "keyword": CODES[i], "ranking": i + 1, "wra": round(wins / (wins + losses), 3),
        "gameCount": wins + losses + 2, "winGameCount": wins, "drawnGameCount": 2, "loseGameCount": losses, "gameBehind": 4.0 * i,
        "continuousGameResult": "2승", "lastFiveGames": "WLWLD", "extra": 1,
    }
    return {**row, **change}


def standings(spark, rows=None, **envelope):
    body = {"code": 200, "success": True, "result": {"seasonTeamStats": rows if rows is not None else [team_row(i) for i in range(10)], "gameType": "REGULAR_SEASON"}, **envelope}
    df = spark.createDataFrame([(2026, dt.date(2026, 9, 15), json.dumps(body))], "season int, as_of date, payload string")
    return FD.flatten_standings(df)


def codes(df):
    return sorted({r.code for r in df.collect()})


def test_standings_feed_and_invariants(spark):
    feed = standings(spark)
    assert feed.rows.count() == 10 and feed.quarantine.count() == 0
    assert G.validate_standings(feed.rows).count() == 0
    assert G.standings_lines(feed.rows).first().line == "1위 LG 70승 34패 2무 승률 0.673 게임차 - 최근5경기 WLWLD 2승"
    for broken in ({"success": False}, {"code": 500}, {"result": []}, {"result": {"seasonTeamStats": {}}}):
        feed = standings(spark, **broken)
        assert feed.rows.count() == 0 and feed.quarantine.count() == 1


def test_each_broken_standing_fails_its_check(spark):
    rows = [team_row(i) for i in range(10)]
    mutations = {
        "UNKNOWN_TEAM": {"teamId": "XX"}, "RANK_RANGE": {"ranking": 11}, "WRA_RANGE": {"wra": 67.3}, "LAST_FIVE": {"lastFiveGames": "WLX"},
        "KEYWORD_BLANK": {"keyword": " "}, "GAMES_SUM": {"gameCount": 1}, "WRA_DEFINITION": {"wra": 0.5}, "WINS_LOSSES": {"winGameCount": 71},
    }
    for code, change in mutations.items():
        assert code in codes(G.validate_standings(standings(spark, [*rows[:9], {**rows[9], **change}]).rows)), code
    assert "TEAM_COUNT" in codes(G.validate_standings(standings(spark, rows[:9]).rows))
    swapped = [{**rows[0], "ranking": 2}, {**rows[1], "ranking": 1}, *rows[2:]]
    assert codes(G.validate_standings(standings(spark, swapped).rows)) == ["RANK_ORDER"]


def game(day, hour, home, away, status="BEFORE", **change):
    gid = f"202609{day:02d}{away}{home}02026"
    row = {
        "gameId": gid, "gameDate": f"2026-09-{day:02d}", "gameDateTime": f"2026-09-{day:02d}T{hour:02d}:30:00", "roundCode": "kbo_r", "stadium": "잠실", "homeTeamCode": home,
        "awayTeamCode": away, "homeTeamName": home, "awayTeamName": away, "statusCode": status, "cancel": False,
    }
    return {**row, **change}


GAMES = [
    game(13, 18, "LG", "SS", "RESULT", homeTeamScore=3, awayTeamScore=2), game(14, 18, "OB", "NC", "RESULT", homeTeamScore=1, awayTeamScore=4),
    game(15, 14, "LG", "OB", "STARTED"), game(15, 18, "LG", "NC"), game(16, 18, "SS", "LG", stadium="대구"), game(17, 18, "OB", "SS", cancel=True),
    game(18, 18, "NC", "OB", stadium="창원"), game(19, 18, "EA", "WE", roundCode="kbo_as"),
]


def schedule(spark, rows=None, total=None):
    rows = GAMES if rows is None else rows
    body = {"code": 200, "success": True, "result": {"games": rows, "gameTotalCount": len(rows) if total is None else total}}
    return FD.flatten_schedule(spark.createDataFrame([(dt.date(2026, 9, 15), json.dumps(body))], "as_of date, payload string")).rows


def now():
    return F.lit("2026-09-15 15:00:00").cast("timestamp_ntz")


def test_schedule_views(spark):
    games = schedule(spark)
    assert G.validate_games(games).count() == 0
    assert sorted(r.game_date.day for r in G.remaining(games, F.lit("2026-09-15").cast("date")).collect()) == [15, 16, 18]
    assert [r.game_date.day for r in G.upcoming(games, now()).orderBy("game_date_time").collect()] == [15, 16, 18]
    assert G.last_finished(games, now()).first().game_id.startswith("20260915OBLG")
    assert G.for_team(games, "SS").count() == 3


def test_each_broken_game_fails_its_check(spark):
    bad = {
        "GAME_ID_FORM": game(15, 18, "LG", "NC", gameId="x"), "SIDES_SWAPPED": game(15, 18, "LG", "NC", homeTeamCode="NC", awayTeamCode="LG"),
        "SAME_TEAM": game(15, 18, "LG", "LG"), "DATE_MISMATCH": game(15, 18, "LG", "NC", gameDate="20260914"),
        "SCORE_BEFORE_START": game(15, 18, "LG", "NC", homeTeamScore=1), "UNKNOWN_TEAM": game(15, 18, "EA", "WE"), "STATUS_UNKNOWN": game(15, 18, "LG", "NC", statusCode="??"),
    }
    for code, row in bad.items():
        assert code in codes(G.validate_games(schedule(spark, [row]))), code
    assert codes(G.validate_games(schedule(spark, total=78))) == ["COUNT_MISMATCH"]


def test_pick_game(spark):
    rows = [
        (0, ["LG"], None, "upcoming"), (1, ["LG"], "대구", "upcoming"), (2, ["LG"], None, "last_finished"), (3, ["SS"], "창원", "upcoming"), (4, [], "아무데나", "upcoming"),
        (5, ["KT"], None, "upcoming"), (6, ["NC"], "창원", "last_finished"), (7, ["SS"], None, "last_finished"),
    ]
    queries = spark.createDataFrame(rows, "qid int, codes array<string>, venue string, prefer string")
    out = G.pick_game(queries, schedule(spark), now()).orderBy("qid").collect()
    assert [(r.relation, r.game.game_date.day if r.game else None) for r in out] == [
        ("upcoming", 15), ("upcoming", 16), ("last_finished", 15), ("none", None), ("upcoming", 15), ("none", None), ("upcoming", 18), ("last_finished", 13),
    ]


def hitter(pid, **change):
    row = {
        "playerId": pid, "playerName": f"선수{pid}", "teamId": "LG", "backNumber": 7, "height": 180, "weight": 80, "isQualified": True, "isRetire": "N", "ranking": 3,
        "profile": json.dumps({"position": "외야수"}), "hitterGameCount": 100, "hitterHra": 0.31449, "hitterHit": 110, "hitterHr": 10, "hitterRbi": 60, "hitterOps": 0.9005,
    }
    return {**row, **change}


def pitcher(pid, **change):
    row = {
        "playerId": pid, "playerName": f"선수{pid}", "teamId": "LG", "backNumber": None, "isRetire": "N", "profile": json.dumps({"position": "투수"}), "pitcherGameCount": 30,
        "pitcherEra": 3.456, "pitcherWin": 10, "pitcherLose": 5, "pitcherSave": 2, "pitcherWhip": 1.234, "pitcherInning": "138 2/3",
    }
    return {**row, **change}


def players(spark):
    def body(rows):
        return json.dumps({"success": True, "result": {"seasonPlayerStats": rows}}, ensure_ascii=False)

    hitters = [hitter(1), hitter(2, hitterGameCount=50, profile=None), hitter(9, profile=json.dumps({"position": "투수"}), hitterGameCount=99), hitter(4, isRetire="Y")]
    rows = [("HITTER", body(hitters)), ("PITCHER", body([pitcher(9), pitcher(8, profile="broken")])), ("PITCHER", body([])), ("HITTER", json.dumps({"success": False}))]
    return FD.flatten_players(spark.createDataFrame(rows, "player_type string, payload string"))


def test_players(spark, tmp_path):
    feed = players(spark)
    assert feed.quarantine.count() == 2
    unique = {r.player_id: r for r in G.dedupe_players(feed.rows).collect()}
    assert set(unique) == {"1", "2", "4", "8", "9"}
    assert unique["9"].player_type == "PITCHER" and unique["9"].stats.innings_value == 138.667 and unique["9"].stats.era == 3.46
    assert unique["1"].stats.avg == 0.314 and unique["1"].position == "외야수" and unique["2"].position == "야수" and unique["8"].position == "투수"
    assert unique["4"].is_retired and unique["1"].is_qualified
    FL.write_players(feed.rows, str(tmp_path), season=2026, captured_at="2026-09-15")
    back = FL.read_players(spark, f"{tmp_path}/meta")
    assert back.count() == 0 and FL.players_meta(spark, f"{tmp_path}/meta").first().player_count == 5
    assert spark.read.json(f"{tmp_path}/players").count() == 5
    assert G.roster(feed.rows, "LG", "HITTER").count() == 3 and G.roster(feed.rows, "LG", "HITTER", include_retired=True).count() == 4
    count = G.roster_counts(G.dedupe_players(feed.rows)).first()
    assert (count.hitters, count.pitchers) == (3, 2)


def test_json_lines_players(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(
        json.dumps({"_meta": True, "season": 2026, "captured_at": "2026-09-15", "player_count": 1})
        + "\n" + json.dumps({"player_id": "1", "name": "가", "team_code": "LG", "stats": {"games": 3, "avg": 0.3}}) + "\n"
    )
    rows = FL.read_players(spark, str(tmp_path / "p.jsonl")).collect()
    assert len(rows) == 1 and rows[0].stats.games == 3 and FL.players_meta(spark, str(tmp_path / "p.jsonl")).first().season == 2026


def test_dims(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"as_of": "x", "teams": [{"code": "LG", "full": "LG 트윈스", "aliases": ["LG", "엘지"]}, {"code": "OB", "aliases": []}]}))
    (tmp_path / "c.json").write_text(json.dumps({"channels": [{"code": "KBO", "handle": "@k"}]}))
    (tmp_path / "r.json").write_text(json.dumps({"items": [{"id": "abs", "title": "t", "keywords": ["ABS"], "text": "x", "as_of": "2026-09-15"}]}))
    (tmp_path / "g.json").write_text(json.dumps([{"term_no": 1, "term_en": "A", "aliases": ["A"], "page": 3}]))
    (tmp_path / "e.json").write_text(json.dumps({"cases": [{"id": 1, "question": "q", "expected_rule_refs": ["5.09"], "expect_llm_called": False}]}))
    assert [(r.ord, r.code, r.aliases) for r in FL.load_dim(spark, str(tmp_path / "t.json"), "teams").orderBy("ord").collect()] == [(0, "LG", ["LG", "엘지"]), (1, "OB", [])]
    assert FL.load_dim(spark, str(tmp_path / "c.json"), "channels").first().handle == "@k"
    assert FL.load_regulations(spark, str(tmp_path / "r.json")).first().as_of == dt.date(2026, 9, 15)
    assert FL.load_dim(spark, str(tmp_path / "g.json"), "glossary").first().page == 3
    assert FL.read_golden(spark, str(tmp_path / "e.json")).first().expected_rule_refs == ["5.09"]


def team_dim(spark):
    rows = [("LG", "LG 트윈스", "LG", ["LG", "엘지", "트윈스", "LG트윈스"], "서울", "잠실야구장", "u1"), ("SS", "삼성 라이온즈", "삼성", ["삼성", "라이온즈"], "대구", "라이온즈파크", "u2"),
            ("NC", "NC 다이노스", "NC", ["NC"], "창원", "NC파크", "u3")]
    return spark.createDataFrame(rows, "code string, full string, short string, aliases array<string>, hometown string, stadium string, source_url string")


def test_entries(spark):
    rows = [(0, "LG 순위 일정", ["standings", "schedule"], ["LG"]), (1, "LG 투수 명단", ["roster"], ["LG"]), (2, "삼성 명단", ["roster"], ["SS"]), (3, "연고지", ["team_info"], ["LG", "SS", "NC"]), (4, "일정", ["schedule"], []), (5, "LG 선수단", ["roster"], ["LG"])]
    queries = spark.createDataFrame(rows, "qid int, text string, topics array<string>, teams array<string>")
    out = G.entries_for_queries(
        queries, teams=team_dim(spark), standings=standings(spark).rows, games=schedule(spark), players=G.dedupe_players(players(spark).rows),
        today=F.lit("2026-09-15").cast("date"), source_url="s", dim_as_of="2026-09-01", dim_source="위키", captured_at="2026-09-15",
    ).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.qid, r.position)):
        got.setdefault(r.qid, []).append(r)
    assert [r.kind for r in got[0]] == ["standings", "schedule"] and got[0][0].text.count("\n") == 9
    assert got[0][1].label == "LG 트윈스 남은 경기" and got[0][1].text.startswith("남은 경기 2경기\n2026-09-15(Tue) 18:30 NC vs LG 잠실")
    assert got[1][0].label == "LG 트윈스 투수 명단 (2명, 이번 시즌 출전 기준)" and "30경기 10승 5패 2세이브 평균자책 3.46" in got[1][0].text
    assert 2 not in got
    assert [r.label for r in got[3]] == ["LG 트윈스 구단 정보", "삼성 라이온즈 구단 정보"] and "현재 순위: 1위 (70승 34패 2무, 승률 0.673)" in got[3][0].text
    assert got[4][0].label == "KBO 2026 남은 경기" and got[4][0].text.startswith("남은 경기 3경기")
    assert got[5][0].text.startswith("[투수 2명]\n") and "[타자 2명]\n#7 선수1 (외야수) — 100경기 타율 0.314 10홈런 60타점" in got[5][0].text


def test_video_feeds(spark):
    def item(vid, title="t", at="2026-09-16T15:30:00Z", **snippet):
        return {"snippet": {"title": title, "channelTitle": "c", "resourceId": {"videoId": vid}, **snippet}, "contentDetails": {"videoPublishedAt": at}}

    good = {"items": [item("a" * 11), item("bad"), item("b" * 11, "Deleted video"), item("c" * 11, at=None), item("d" * 11, videoOwnerChannelTitle="own")]}
    broken = {"items": [{"snippet": {"title": "x"}, "contentDetails": {}}]}
    rows = [("UU1", json.dumps(good)), ("UU2", json.dumps(broken)), ("UU3", "{}")]
    feed = FD.flatten_playlist(spark.createDataFrame(rows, "playlist_id string, payload string"))
    assert [(r["id"][0], r.channel_title, r.published_at) for r in feed.rows.orderBy("arrival").collect()] == [("a", "c", dt.date(2026, 9, 17)), ("d", "own", dt.date(2026, 9, 17))]
    assert sorted(r.problem for r in feed.quarantine.collect()) == ["items_not_list", "resource_missing"]
    video = {"id": "a" * 11, "snippet": {"title": "t", "publishedAt": "2026-09-16T10:00:00Z", "thumbnails": {"default": {"url": "d"}}}, "contentDetails": {"duration": "PT12M41S"}, "status": {"embeddable": False}}
    feed = FD.flatten_videos(spark.createDataFrame([(json.dumps({"items": [video]}),), (json.dumps({"items": [{**video, "status": {}}]}),)], "payload string"))
    row = feed.rows.first()
    assert (row.duration_seconds, row.duration, row.embeddable, row.thumbnail_url) == (761, "12:41", False, "d") and feed.rows.count() == 1
    assert feed.quarantine.first().problem == "embeddable_missing"


def test_date_mentions_reproduce_containment(spark):
    titles = ["9.13 LG", "2026.09.13", "12/31", "9월 13일", "9월3일 h", "no", "10.1x 1.10", "19월 2일"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string").select("t", P.date_mentions(F.col("t")).alias("m"))
    for row in df.collect():
        want = set()
        for m in range(1, 13):
            for d in range(1, 32):
                spelled = (f"{m}.{d}", f"{m:02d}.{d:02d}", f"{m}/{d}", f"{m:02d}/{d:02d}", f"{m}월 {d}일", f"{m}월{d}일")
                if any(s in row.t for s in spelled):
                    want.add(f"{m}-{d}")
        assert want <= set(row.m), (row.t, want, row.m)
        valid = {x for x in row.m if 1 <= int(x.split("-")[0]) <= 12 and 1 <= int(x.split("-")[1]) <= 31}
        assert valid == want, (row.t, want, row.m)


def test_highlights(spark):
    day = dt.date(2026, 9, 13)
    games = spark.createDataFrame(
        [("g1", day, "LG", "SS", "LG", "삼성"), ("g2", day, "NC", "XX", "NC", "XX"), ("g3", dt.date(2026, 5, 1), "LG", "SS", "LG", "삼성"), ("g4", day, "SS", "NC", "삼성", "NC")],
        "game_id string, game_date date, home_code string, away_code string, home_name string, away_name string",
    )
    channels = spark.createDataFrame([("LG",), ("KBO",), ("SS",)], "code string")
    uploads = [
        ("LG", "v1", "9.13 LG vs 삼성 주요장면", "2026-09-13"), ("LG", "v2", "9.13 경기 예고", "2026-09-13"), ("LG", "v3", "승리 인터뷰 9.13", "2026-09-13"),
        ("KBO", "v4", "[삼성라이온즈 vs LG트윈스] 9.13(일) 하이라이트", "2026-09-13"), ("KBO", "v5", "[NC vs KT] 9.13 하이라이트", "2026-09-14"), ("LG", "v6", "그냥 영상", "2026-09-14"),
        ("KBO", "v7", "[삼성 vs NC] 9.13 하이라이트", "2026-09-14"),
    ]
    ups = spark.createDataFrame(uploads, "code string, id string, title string, published_at string").withColumn("published_at", F.to_date("published_at"))
    details = ups.select("id", "title", "published_at", F.lit("1:00").alias("duration"), F.lit(True).alias("embeddable"), F.lit("t").alias("thumbnail_url"), F.lit("u").alias("url"))
    trace = P.channel_trace(games, channels, ups, team_dim(spark)).collect()
    got = {(r.game_id, r.code): (r.stage, r.received, r.passed, r.top) for r in trace}
    # The league's channel comes last, and only if no club's channel gave a video.
    assert got["g1", "LG"] == ("channel", 4, 1, 6) and ("g1", "SS") not in got and ("g1", "KBO") not in got
    assert got["g4", "SS"] == ("playlist_empty", 0, 0, 0) and got["g4", "KBO"] == ("channel", 3, 1, 6)
    assert got["g2", "KBO"][:3] == ("channel", 3, 0) and got["g3", "LG"] == ("channel", 4, 0, 0) and len(got) == 7
    picked, stages = P.find_highlights(games, channels, ups, details, team_dim(spark))
    assert sorted((r.game_id, r["id"], r.score) for r in picked.collect()) == [("g1", "v1", 6), ("g4", "v7", 6)]
    assert {r.game_id: r.stage for r in stages.collect()} == {"g1": "ok", "g2": "no_candidate", "g3": "no_candidate", "g4": "ok"}
    _, stages = P.find_highlights(games, channels.limit(0), ups, details, team_dim(spark))
    assert {r.stage for r in stages.collect()} == {"no_channel"}
    _, stages = P.find_highlights(games, channels, ups, details.limit(0), team_dim(spark))
    assert {r.game_id: r.stage for r in stages.collect()}["g1"] == "verify_failed"
    fallback = spark.createDataFrame([("g2", "v1"), ("g3", "v4")], "game_id string, id string")
    _, stages = P.find_highlights(games, channels, ups, details, team_dim(spark), fallback=fallback)
    assert {r.game_id: r.stage for r in stages.collect()} == {"g1": "ok", "g2": "score_below_min", "g3": "score_below_min", "g4": "ok"}
    _, stages = P.find_highlights(games, channels, ups, details, team_dim(spark), enabled=False)
    assert {r.stage for r in stages.collect()} == {"disabled"}


def test_highlights_query_asks_the_web_where_channels_give_none(spark, tmp_path):
    """Games 10, 25 (listed twice) and 31 get the web's video, 61 one that cannot be looked up; 33 is not on the web, 40 has no channel, 22 has its own."""
    from driver_queries import records

    orders = [(10, 1), (31, 1), (61, 1), (33, 1), (40, 9), (22, 3), (25, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    at = [(10, 11), (31, 2), (33, 4), (40, 11), (22, 23), (150, 23), (25, 26), (25, 26)]
    events = [(i, 3 if i == 150 else 2, dt.datetime(2024, 1, day, 1)) for i, day in at]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    rows = records.R.queries["find_highlights"](spark, str(tmp_path)).collect()
    got = {int(r.game_id): (r.stage, r.id, r.place, r.score) for r in rows}
    assert len(rows) == len(got)
    none = (None, None, None)
    assert got == {
        10: ("ok", "10", 1, 5), 31: ("score_below_min", *none), 61: ("verify_failed", *none),
        33: ("no_candidate", *none), 40: ("no_channel", *none), 22: ("ok", "150", 1, 5), 25: ("ok", "25", 1, 5),
    }


def test_titles_of_earlier_seasons_do_not_match(spark):
    games = spark.createDataFrame([("g", "LG", 0, dt.date(2026, 9, 13))], "game_id string, code string, priority int, game_date date")
    days = {"old": "2021-09-13", "early": "2026-09-12", "same": "2026-09-13", "late": "2026-10-13", "later": "2026-10-14", "unknown": None}
    videos = spark.createDataFrame([("LG", k, "9.13 하이라이트", d) for k, d in days.items()], "code string, id string, title string, published_at string")
    found = P.match_videos(games, videos.withColumn("published_at", F.to_date("published_at"))).collect()
    assert sorted(r["id"] for r in found) == ["late", "same", "unknown"]


def test_places(spark):
    rows = [("q", i, t, u, c, s, None) for i, (t, u, c, s) in enumerate([("맛집 1", "u1", "c" * 300, 0.9), ("낮음", "u2", "c", 0.3), ("맛집 1", "u1", "d", 0.8), ("", "u3", "e", 0.9), ("맛집 2", "u4", "", 0.65)])]
    df = spark.createDataFrame(rows, "query string, position int, title string, url string, content string, score double, published_date string")
    stadiums = spark.createDataFrame([("q", "잠실야구장"), ("none", "x")], "query string, stadium string")
    entries, cards, maps = P.build_places(df, stadiums, F.lit("2026-09-15").cast("date"), with_map=True)
    got = entries.orderBy("position").collect()
    assert [r.label for r in got] == ["맛집 정보 안내", "맛집 정보: 맛집 1", "맛집 정보: 맛집 2"] and len(got[1].text) == 220
    assert [(r.name, r.confidence, r.snippet is None) for r in cards.orderBy("position").collect()] == [("맛집 1", "likely", False), ("맛집 2", "uncertain", True)]
    assert [(r.kind, r.map_query) for r in maps.collect()] == [("map", "잠실야구장 근처 맛집")]
    assert P.build_places(df.limit(0), stadiums, F.lit("2026-09-15").cast("date"))[0].count() == 0


def test_standings_read_a_response_once_and_not_for_every_team(spark):
    """What reads the payload lies below the explode, so work does not grow with payload times teams."""
    from corvane.sources import feeds

    teams = ",".join(f'{{"teamId":"t{i}","ranking":{i}}}' for i in range(3))
    body = f'{{"success":true,"code":200,"result":{{"gameType":"POST","seasonTeamStats":[{teams}]}}}}'
    rows = feeds.flatten_standings(spark.createDataFrame([(2026, "d", body)], "season int, as_of string, payload string")).rows
    assert [(r.game_type, r.arrival, r.team_id, r.ranking) for r in rows.collect()] == [("POST", i, f"t{i}", i) for i in range(3)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan.split("Generate")[0]
