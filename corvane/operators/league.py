"""League tables: invariants, schedule picks, rosters, team facts and context entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.operators.ranking import first_per_key, top_n_per_group

# Codes, states, tolerances, caps and line forms.
TEAM_CODES = ("KT", "SS", "LG", "HT", "OB", "NC", "SK", "HH", "LT", "WO")
REGULAR_ROUND = "kbo_r"
GAME_ID = r"^\d{8}([A-Z]{2})([A-Z]{2})\d{5}$"
KNOWN_STATUS = ("BEFORE", "STARTED", "RESULT", "CANCEL", "POSTPONE")
DONE_STATUS = ("RESULT", "STARTED")
WRA_TOLERANCE = 0.0015
KNOWN_STATUS_RATIO = 0.9
TEAM_COUNT = 10
PITCHER_POSITION = "투수"
MAX_ENTRIES = 3
MAX_TEAM_INFO = 2
SCHEDULE_LINES = 10
ROSTER_LINES = 14
ROSTER_LINES_SPLIT = 8
SOURCE_LABEL = "네이버 스포츠"
TEAM_SOURCE_LABEL = "위키백과"
FATAL = "fatal"
SOFT = "soft"


def _regular() -> Column:
    return F.col("round_code") == REGULAR_ROUND


def remaining(games: DataFrame, today: Column) -> DataFrame:
    """Regular, not started, not cancelled, today or later; a rained-out game still says BEFORE."""
    return games.where(_regular() & (F.col("status_code") == "BEFORE") & ~F.col("cancel") & (F.col("game_date") >= today))


def upcoming(games: DataFrame, now: Column) -> DataFrame:
    return games.where(
        _regular() & ~F.col("cancel") & (F.col("status_code") == "BEFORE") & (F.col("game_date_time") >= now)
    )


def finished(games: DataFrame, now: Column) -> DataFrame:
    return games.where(
        _regular() & ~F.col("cancel") & (F.col("game_date_time") <= now) & F.col("status_code").isin(*DONE_STATUS)
    )


def last_finished(games: DataFrame, now: Column, *keys: str) -> DataFrame:
    return first_per_key(finished(games, now), list(keys), F.struct("game_date_time", "game_id"), last=True)


def for_team(games: DataFrame, code: str) -> DataFrame:
    return games.where((F.col("home_code") == code) | (F.col("away_code") == code))


def pick_game(queries: DataFrame, games: DataFrame, now: Column) -> DataFrame:
    """One game per query with its relation (`upcoming`, `last_finished`, `none`).

    queries: qid, codes array<string>, venue, prefer. Games are first reduced to the nearest ones per
    (team, stadium), so a team holding much of the schedule costs a query a handful of rows. With
    codes given, a venue that is not in the stadium text rejects the game; without codes it does not.
    """
    row = F.struct(*[F.col(c) for c in games.columns])
    at = F.struct("game_date_time", "game_id")
    sided = games.withColumn("code", F.explode(F.array_distinct(F.array("home_code", "away_code", F.lit("*")))))
    near = upcoming(sided, now).groupBy("code", "stadium").agg(F.min_by(row, at).alias("next"))
    past = finished(sided, now).groupBy("code", "stadium").agg(F.max_by(row, at).alias("last"))
    nearest = near.join(past, ["code", "stadium"], "full")
    asked = queries.withColumn(
        "code", F.explode(F.when(F.coalesce(F.size("codes"), F.lit(0)) > 0, F.col("codes")).otherwise(F.array(F.lit("*"))))
    )
    venue_ok = (F.col("code") == "*") | F.col("venue").isNull() | F.contains(F.coalesce("stadium", F.lit("")), F.col("venue"))
    found = asked.join(nearest, "code").where(venue_ok).groupBy("qid").agg(
        F.min_by("next", F.when(F.col("next").isNotNull(), F.struct("next.game_date_time", "next.game_id"))).alias("next"),
        F.max_by("last", F.when(F.col("last").isNotNull(), F.struct("last.game_date_time", "last.game_id"))).alias("last"),
    )
    ahead = F.when(F.col("next").isNotNull(), F.struct(F.lit("upcoming").alias("relation"), F.col("next").alias("game")))
    done = F.when(F.col("last").isNotNull(), F.struct(F.lit("last_finished").alias("relation"), F.col("last").alias("game")))
    pick = F.when(F.col("prefer") == "upcoming", F.coalesce(ahead, done)).otherwise(F.coalesce(done, ahead))
    return queries.join(found, "qid", "left").select(
        "qid", F.coalesce(pick["relation"], F.lit("none")).alias("relation"), pick["game"].alias("game")
    )


def dedupe_players(players: DataFrame) -> DataFrame:
    """One row per player: the list that fits the position, then more games, then the first seen."""
    wanted = F.when(F.col("position") == PITCHER_POSITION, F.lit("PITCHER")).otherwise(F.lit("HITTER"))
    fits = (F.col("player_type") == wanted).cast("int")
    arrival = F.col("arrival") if "arrival" in players.columns else F.lit(0)
    kind = F.when(F.col("player_type") == "HITTER", 0).otherwise(1)
    order = F.struct((-fits).alias("f"), (-F.coalesce("stats.games", F.lit(0))).alias("g"), kind.alias("k"), arrival.alias("a"))
    return first_per_key(players, ["player_id"], order)


def roster(players: DataFrame, team: str | None = None, player_type: str | None = None, *, include_retired: bool = False) -> DataFrame:
    out = players if include_retired else players.where(~F.coalesce("is_retired", F.lit(False)))
    if team:
        out = out.where(F.col("team_code") == team)
    return out.where(F.col("player_type") == player_type) if player_type else out


def roster_counts(players: DataFrame) -> DataFrame:
    kind = F.col("player_type")
    return players.groupBy("team_code").agg(
        F.count_if(kind == "HITTER").alias("hitters"),
        F.count_if(kind == "PITCHER").alias("pitchers"),
        F.count(F.lit(1)).alias("players"),
    )


def roster_top(players: DataFrame, keys: list[str], order: list[Column], limit: int = ROSTER_LINES) -> DataFrame:
    """First `limit` rows per key with `total` and `others`, how many more there are."""
    players = players.drop("total")
    total = players.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    top = top_n_per_group(players, keys, order, limit, rank="place")
    return top.join(total, keys).withColumn("others", F.greatest(F.col("total") - limit, F.lit(0)))


def team_info(teams: DataFrame, standings: DataFrame) -> DataFrame:
    """Team facts with the current standing where there is one."""
    now = standings.select(F.col("team_id").alias("code"), "ranking", "wins", "losses", "draws", "wra", "game_behind", "last_five")
    return teams.join(now, "code", "left")


def standing_line() -> Column:
    gb = F.when(F.col("game_behind") == 0, F.lit("-")).otherwise(F.format_string("%.1f", F.col("game_behind")))
    streak = F.when(F.coalesce("streak", F.lit("")) != "", F.concat(F.lit(" "), "streak")).otherwise(F.lit(""))
    five = F.coalesce(F.nullif(F.col("last_five"), F.lit("")), F.lit("-"))
    return F.concat(
        F.format_string("%d위 %s %d승 %d패 %d무 승률 %.3f", "ranking", "team_short", "wins", "losses", "draws", "wra"),
        F.lit(" 게임차 "), gb, F.lit(" 최근5경기 "), five, streak,
    )


def standings_lines(standings: DataFrame) -> DataFrame:
    return standings.select("season", "ranking", standing_line().alias("line")).orderBy("season", "ranking")


def schedule_lines(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Games with the short names of both teams; an unknown code stands for itself."""
    home = teams.select(F.col("code").alias("home_code"), F.col("short").alias("home_short"))
    away = teams.select(F.col("code").alias("away_code"), F.col("short").alias("away_short"))
    named = games.join(home, "home_code", "left").join(away, "away_code", "left")
    where = F.when(F.coalesce("stadium", F.lit("")) != "", F.concat(F.lit(" "), "stadium")).otherwise(F.lit(""))
    line = F.concat(
        F.date_format("game_date_time", "yyyy-MM-dd(E) HH:mm "), F.coalesce("away_short", "away_code"), F.lit(" vs "),
        F.coalesce("home_short", "home_code"), where,
    )
    return named.withColumn("line", line)


def schedule_head(total: Column, limit: int) -> Column:
    short = F.when(total > limit, F.format_string(" (가까운 %d경기만 표시)", F.lit(limit))).otherwise(F.lit(""))
    return F.concat(F.format_string("남은 경기 %d경기", total), short)


def player_line() -> Column:
    st = "stats."
    zero = F.lit(0)

    def n(name: str) -> Column:
        return F.coalesce(F.col(st + name), zero)

    number = F.coalesce(F.concat(F.lit("#"), F.col("back_number").cast("string")), F.lit("  "))
    head = F.concat(number, F.lit(" "), "name", F.lit(" ("), F.coalesce(F.nullif(F.col("position"), F.lit("")), F.lit("-")), F.lit(")"))
    pitcher = F.concat(
        F.format_string("%d경기 %d승 %d패", n("games"), n("win"), n("lose")),
        F.when(n("save") > 0, F.format_string(" %d세이브", n("save"))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" 평균자책 "), F.col(st + "era").cast("string")), F.lit("")),
    )
    hitter = F.concat(
        F.format_string("%d경기", n("games")),
        F.coalesce(F.format_string(" 타율 %.3f", F.col(st + "avg")), F.lit("")),
        F.format_string(" %d홈런 %d타점", n("hr"), n("rbi")),
    )
    hitter = F.when(F.col(st + "avg").isNull(), F.concat(F.format_string("%d경기", n("games")), F.format_string(" %d홈런 %d타점", n("hr"), n("rbi")))).otherwise(hitter)
    return F.concat(head, F.lit(" — "), F.when(F.col("player_type") == "PITCHER", pitcher).otherwise(hitter))


def _codes(checks: list[tuple[str, str, Column]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, level, c in checks])
    )


def _violations(rows: DataFrame, key: Column, checks: list[tuple[str, str, Column]]) -> DataFrame:
    return rows.select(key.alias("row_key"), F.explode(_codes(checks)).alias("_v")).select("row_key", "_v.code", "_v.level")


def validate_standings(standings: DataFrame) -> DataFrame:
    """(row_key, code, level): seven checks per team row and five per season table."""
    decided = F.col("wins") + F.col("losses")
    expected = F.try_divide(F.col("wins").cast("double"), decided)
    five = F.col("last_five")
    rows = _violations(
        standings,
        F.concat_ws(":", F.col("season").cast("string"), "team_id"),
        [
            ("UNKNOWN_TEAM", FATAL, ~F.col("team_id").isin(*TEAM_CODES)),
            ("RANK_RANGE", SOFT, ~F.col("ranking").between(1, TEAM_COUNT)),
            ("WRA_RANGE", FATAL, ~F.col("wra").between(0.0, 1.0)),
            ("LAST_FIVE", SOFT, (F.length(five) > 5) | five.rlike("[^WLD-]")),
            ("KEYWORD_BLANK", SOFT, F.trim("keyword") == ""),
            ("GAMES_SUM", FATAL, F.col("games") != F.col("wins") + F.col("draws") + F.col("losses")),
            ("WRA_DEFINITION", FATAL, (decided > 0) & (F.abs(F.col("wra") - expected) > WRA_TOLERANCE)),
        ],
    )
    return rows.unionByName(_violations(season_shape(standings), F.col("season").cast("string"), [
        ("TEAM_COUNT", FATAL, F.col("teams") != TEAM_COUNT),
        ("RANK_PERMUTATION", FATAL, (F.col("ranks") != TEAM_COUNT) | (F.col("low") != 1) | (F.col("high") != TEAM_COUNT)),
        ("RANK_ORDER", FATAL, ~F.col("rank_ok")),
        ("WINS_LOSSES", FATAL, F.col("wins") != F.col("losses")),
        ("GAME_TYPE", FATAL, ~F.col("regular")),
    ]))


def season_shape(standings: DataFrame) -> DataFrame:
    """Per season: team count, rank spread, balance of wins and losses, order agreement."""
    shape = standings.groupBy("season").agg(
        F.count(F.lit(1)).alias("teams"),
        F.count_distinct("ranking").alias("ranks"),
        F.min("ranking").alias("low"),
        F.max("ranking").alias("high"),
        F.sum("wins").alias("wins"),
        F.sum("losses").alias("losses"),
        F.bool_and(F.col("game_type") == "REGULAR_SEASON").alias("regular"),
    )
    return shape.join(rank_consistency(standings, ["season"], "ranking", "wra"), "season")


def rank_consistency(rows: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """Whether the value falls (or stays) from each rank to the next one, per key.

    Ranks are whole numbers without gaps (the permutation check says so when not), so neighbours meet
    in an equi-join on the rank and no key is ever sorted in one task.
    """
    spread = rows.groupBy(*keys, F.col(rank).alias("_r")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    after = spread.select(*keys, (F.col("_r") - 1).alias("_r"), F.col("_high").alias("_next"))
    return spread.join(after, [*keys, "_r"], "left").groupBy(*keys).agg(
        F.bool_and(F.col("_next").isNull() | (F.col("_next") <= F.col("_low"))).alias("rank_ok")
    )


def validate_games(games: DataFrame) -> DataFrame:
    """(row_key, code, level): six checks per game and two per schedule (`as_of`)."""
    gid = F.col("game_id")
    formed = gid.rlike(GAME_ID)
    swapped = (F.regexp_extract(gid, GAME_ID, 1) != F.col("away_code")) | (F.regexp_extract(gid, GAME_ID, 2) != F.col("home_code"))
    known = F.col("home_code").isin(*TEAM_CODES) & F.col("away_code").isin(*TEAM_CODES)
    rows = _violations(
        games, gid,
        [
            ("GAME_ID_FORM", FATAL, ~formed),
            ("SIDES_SWAPPED", FATAL, formed & swapped),
            ("SAME_TEAM", SOFT, F.col("home_code") == F.col("away_code")),
            ("DATE_MISMATCH", FATAL, F.col("game_date") != F.to_date("game_date_time")),
            ("SCORE_BEFORE_START", FATAL, (F.col("status_code") == "BEFORE") & ((F.col("home_score") != 0) | (F.col("away_score") != 0))),
            ("UNKNOWN_TEAM", FATAL, _regular() & ~known),
        ],
    )
    shape = schedule_shape(games)
    return rows.unionByName(_violations(shape, F.col("as_of").cast("string"), [
        ("COUNT_MISMATCH", FATAL, F.col("total").isNotNull() & (F.col("games") != F.col("total"))),
        ("STATUS_UNKNOWN", FATAL, F.col("known_ratio") < KNOWN_STATUS_RATIO),
    ]))


def schedule_shape(games: DataFrame) -> DataFrame:
    return games.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("games"),
        F.max("total").alias("total"),
        F.avg(F.col("status_code").isin(*KNOWN_STATUS).cast("double")).alias("known_ratio"),
    )


def known_status_ratio(rows: DataFrame, keys: list[str], status: str, known: tuple[str, ...] = KNOWN_STATUS, ratio: float = KNOWN_STATUS_RATIO) -> DataFrame:
    share = F.avg(F.col(status).isin(*known).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.round(share, 6).alias("known_ratio"), (share >= ratio).alias("ok")
    )


def _entry(kind: str, position: int, label: Column, text: Column, as_of: Column, source: str, url: Column, freshness: Column) -> list[Column]:
    return [
        F.col("qid"), F.lit(kind).alias("kind"), F.lit(position).alias("topic_order"), label.alias("label"),
        text.alias("text"), as_of.cast("string").alias("as_of"), F.lit(source).alias("source_label"),
        url.alias("source_url"), freshness.alias("freshness"),
    ]


def _roster_text(players: DataFrame, limit: int) -> DataFrame:
    """Per (team, list): the first `limit` lines and the count of the others, as one text."""
    rows = players.withColumn("_line", player_line())
    order = [F.desc(F.coalesce("stats.games", F.lit(0))), F.col("name")]
    top = roster_top(rows, ["team_code", "player_type"], order, limit)
    lines = F.array_sort(F.collect_list(F.struct("place", F.col("_line").alias("t"))))
    body = F.array_join(F.transform(lines, lambda x: x["t"]), "\n")
    more = F.when(F.max("others") > 0, F.format_string("\n(이 밖에 %d명)", F.max("others"))).otherwise(F.lit(""))
    return top.groupBy("team_code", "player_type").agg(F.concat(body, more).alias("text"), F.max("total").alias("n"))


def entries_for_queries(
    queries: DataFrame,
    *,
    teams: DataFrame,
    standings: DataFrame,
    games: DataFrame,
    players: DataFrame,
    today: Column,
    source_url: str,
    dim_as_of: str = "",
    dim_source: str = "",
    captured_at: str = "",
    freshness: str = "live",
    limit: int = MAX_ENTRIES,
) -> DataFrame:
    """Context entries per query and topic, in topic order, at most `limit`.

    queries: qid, text, topics, teams. Every text a topic can show is made once per team, so queries
    join to a table of a few rows per team.
    """
    has = {t: queries.where(F.array_contains("topics", t)) for t in ("standings", "schedule", "team_info", "roster")}
    fresh, url = F.lit(freshness), F.lit(source_url)
    known = teams.select("code", "full")

    rows = standings.withColumn("_line", standing_line())
    lines = F.array_sort(F.collect_list(F.struct("ranking", F.col("_line").alias("t"))))
    table = rows.groupBy("season").agg(
        F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("_text"), F.max("as_of").alias("_as_of")
    )
    standing_rows = has["standings"].withColumn("season", F.year(today)).join(table, "season").select(
        *_entry("standings", 0, F.format_string("KBO %d 정규시즌 순위", F.col("season")), F.col("_text"), F.col("_as_of"), SOURCE_LABEL, url, fresh)
    )

    left = schedule_lines(remaining(games, today), teams)
    sided = left.withColumn("code", F.explode(F.array_distinct(F.array("home_code", "away_code", F.lit("*")))))
    near = roster_top(sided, ["code"], [F.col("game_date_time"), F.col("game_id")], SCHEDULE_LINES)
    listed = F.array_sort(F.collect_list(F.struct("place", "line")))
    plan = near.groupBy("code").agg(
        F.concat_ws("\n", schedule_head(F.max("total"), SCHEDULE_LINES), F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("_text"),
        F.max("as_of").alias("_as_of"),
    )
    one_team = F.when(F.size("teams") == 1, F.col("teams")[0]).otherwise(F.lit("*"))
    year = F.year(today)
    schedule_rows = (
        has["schedule"].withColumn("code", one_team).join(plan, "code", "left").join(known, "code", "left")
        .select(*_entry("schedule", 1, F.coalesce(F.concat("full", F.lit(" 남은 경기")), F.format_string("KBO %d 남은 경기", year)),
                        F.coalesce("_text", F.lit("남은 경기 0경기")), F.col("_as_of"), SOURCE_LABEL, url, fresh))
    )

    active = roster(players)
    long, short = _roster_text(active, ROSTER_LINES), _roster_text(active, ROSTER_LINES_SPLIT)
    both = long.select("team_code", "player_type", F.col("text").alias("long"), "n").join(
        short.select("team_code", "player_type", F.col("text").alias("short")), ["team_code", "player_type"]
    )
    side = both.groupBy("team_code").agg(
        *[F.max(F.when(F.col("player_type") == t, F.struct("long", "short", "n"))).alias(t) for t in ("PITCHER", "HITTER")]
    )
    p, h = F.col("PITCHER"), F.col("HITTER")
    pn, hn = F.coalesce(p["n"], F.lit(0)), F.coalesce(h["n"], F.lit(0))
    wants_p, wants_h = L.hit(F.col("text"), L.WANTS_PITCHER), L.hit(F.col("text"), L.WANTS_HITTER)
    blank = F.lit("")
    split = F.concat(
        F.format_string("[투수 %d명]\n", pn), F.coalesce(p["short"], blank),
        F.format_string("\n\n[타자 %d명]\n", hn), F.coalesce(h["short"], blank),
    )
    only_p, only_h = wants_p & ~wants_h, wants_h & ~wants_p
    what = F.when(only_p, F.lit("투수")).when(only_h, F.lit("타자")).otherwise(F.lit("선수"))
    count = F.when(only_p, pn).when(only_h, hn).otherwise(pn + hn)
    body = F.when(only_p, F.coalesce(p["long"], blank)).when(only_h, F.coalesce(h["long"], blank)).otherwise(split)
    roster_rows = (
        has["roster"].withColumn("code", F.get("teams", F.lit(0)))
        .join(side.withColumnRenamed("team_code", "code"), "code").join(known, "code")
        .select(*_entry("roster", 2, F.concat("full", F.lit(" "), what, F.format_string(" 명단 (%d명, 이번 시즌 출전 기준)", count)),
                        body, F.lit(captured_at), SOURCE_LABEL, url, F.lit("static")))
    )

    info = team_info(teams, standings).withColumnRenamed("source_url", "_url")
    facts = F.concat(
        F.lit("구단: "), "full", F.lit("\n연고지: "), "hometown", F.lit("\n홈구장: "), "stadium",
        F.when(F.col("ranking").isNotNull(), F.format_string("\n현재 순위: %d위 (%d승 %d패 %d무, 승률 %.3f)", "ranking", "wins", "losses", "draws", "wra")).otherwise(blank),
        F.lit(f"\n출처: {dim_source} "), F.coalesce("_url", blank),
    )
    info_rows = (
        has["team_info"].select("qid", F.posexplode(F.slice("teams", 1, MAX_TEAM_INFO)).alias("_nth", "code"))
        .join(info, "code")
        .select("_nth", *_entry("team_info", 3, F.concat("full", F.lit(" 구단 정보")), facts, F.lit(dim_as_of), TEAM_SOURCE_LABEL, F.col("_url"), F.lit("static")))
    )

    everything = (
        standing_rows.withColumn("_nth", F.lit(0)).unionByName(schedule_rows.withColumn("_nth", F.lit(0)))
        .unionByName(roster_rows.withColumn("_nth", F.lit(0))).unionByName(info_rows)
    )
    return top_n_per_group(everything, ["qid"], [F.col("topic_order"), F.col("_nth")], limit, rank="position").drop("_nth")
