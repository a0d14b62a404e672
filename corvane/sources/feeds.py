"""Upstream JSON responses to flat tables; a broken response goes to a quarantine table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import values as V

# Response fields, field renames, skip titles and rounding.
STANDINGS_FIELDS = {
    "teamId": ("team_id", "string"), "teamName": ("team_name", "string"), "teamShortName": ("team_short", "string"),
    "keyword": ("keyword", "string"), "ranking": ("ranking", "int"), "wra": ("wra", "double"),
    "gameCount": ("games", "int"), "winGameCount": ("wins", "int"), "drawnGameCount": ("draws", "int"),
    "loseGameCount": ("losses", "int"), "gameBehind": ("game_behind", "double"),
    "continuousGameResult": ("streak", "string"), "lastFiveGames": ("last_five", "string"),
}
GAME_FIELDS = {
    "gameId": ("game_id", "string"), "gameDate": ("game_date", "string"), "gameDateTime": ("game_date_time", "string"),
    "roundCode": ("round_code", "string"), "stadium": ("stadium", "string"), "homeTeamCode": ("home_code", "string"),
    "awayTeamCode": ("away_code", "string"), "homeTeamName": ("home_name", "string"), "awayTeamName": ("away_name", "string"),
    "homeTeamScore": ("home_score", "int"), "awayTeamScore": ("away_score", "int"), "statusCode": ("status_code", "string"),
    "cancel": ("cancel", "boolean"), "suspended": ("suspended", "boolean"),
}
HITTER_STATS = {
    "games": "hitterGameCount", "avg": "hitterHra", "hits": "hitterHit", "hr": "hitterHr", "rbi": "hitterRbi",
    "runs": "hitterRun", "sb": "hitterSb", "bb": "hitterBb", "so": "hitterKk", "obp": "hitterObp",
    "slg": "hitterSlg", "ops": "hitterOps",
}
PITCHER_STATS = {
    "games": "pitcherGameCount", "era": "pitcherEra", "win": "pitcherWin", "lose": "pitcherLose",
    "save": "pitcherSave", "hold": "pitcherHold", "so": "pitcherKk", "bb": "pitcherBb", "whip": "pitcherWhip",
    "quality_starts": "pitcherQs",
}
STAT_COLUMNS = (
    "games", "avg", "hits", "hr", "rbi", "runs", "sb", "bb", "so", "obp", "slg", "ops", "era", "win", "lose", "save",
    "hold", "whip", "quality_starts",
)
RATES_3 = ("avg", "obp", "slg", "ops")
RATES_2 = ("era", "whip")
PITCHER_POSITION = "투수"
HITTER_POSITION = "야수"
SKIPPED_TITLES = ("Deleted video", "Private video")
WATCH_URL = "https://www.youtube.com/watch?v="
DEFAULT_GAME_TYPE = "REGULAR_SEASON"


@dataclass
class Feed:
    rows: DataFrame
    quarantine: DataFrame


def json_path(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)


def _envelope(responses: DataFrame, payload: str, items: str) -> DataFrame:
    """Adds `problem`: why a response cannot be read, null when it can."""
    p = F.col(payload)
    ok = (json_path(p, "$.success") == "true") & (json_path(p, "$.code") == "200")
    result, rows = json_path(p, "$.result"), json_path(p, f"$.result.{items}")
    problem = (
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("not_successful"))
        .when(~F.coalesce(result.startswith("{"), F.lit(False)), F.lit("result_not_object"))
        .when(~F.coalesce(rows.startswith("["), F.lit(False)), F.lit("items_not_list"))
    )
    return responses.withColumn("problem", problem)


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())


def _inlined(good: DataFrame, payload: str, items: str, fields: dict[str, tuple[str, str]], keep: list[Column]) -> DataFrame:
    ddl = ", ".join(f"`{n}` {kind}" for n, (_, kind) in fields.items())
    rows = F.from_json(json_path(F.col(payload), f"$.result.{items}"), f"array<struct<{_colons(ddl)}>>")
    # Beside a generator, an expression is evaluated for every row that comes out, so what reads the payload comes first.
    once = good.select(*keep, rows.alias("_rows"))
    flat = once.select(*[c for c in once.columns if c != "_rows"], F.posexplode("_rows").alias("arrival", "_r"))
    names = [c for c in flat.columns if c != "_r"]
    return flat.select(*names, *[F.col(f"_r.{n}").alias(new) for n, (new, _) in fields.items()])


def _colons(ddl: str) -> str:
    return ", ".join("{}:{}".format(*part.split(" ", 1)) for part in ddl.split(", "))


def flatten_standings(responses: DataFrame, *, payload: str = "payload") -> Feed:
    """responses: season, as_of, payload."""
    good, bad = _split(_envelope(responses, payload, "seasonTeamStats"))
    kind = F.coalesce(json_path(F.col(payload), "$.result.gameType"), F.lit(DEFAULT_GAME_TYPE))
    return Feed(
        _inlined(good, payload, "seasonTeamStats", STANDINGS_FIELDS, [F.col("season"), F.col("as_of"), kind.alias("game_type")]), bad
    )


def flatten_schedule(responses: DataFrame, *, payload: str = "payload") -> Feed:
    """responses: as_of, payload. Times stay wall-clock values without a zone."""
    good, bad = _split(_envelope(responses, payload, "games"))
    total = json_path(F.col(payload), "$.result.gameTotalCount").try_cast("int").alias("total")
    rows = _inlined(good, payload, "games", GAME_FIELDS, [F.col("as_of"), total])
    filled = rows.fillna({"round_code": "", "home_name": "", "away_name": "", "home_score": 0, "away_score": 0, "cancel": False, "suspended": False})
    return Feed(
        filled.withColumn("game_date", V.date8(F.col("game_date"))).withColumn(
            "game_date_time", F.col("game_date_time").try_cast("timestamp_ntz")
        ),
        bad,
    )


def normalize_players(rows: DataFrame, *, row: str = "row", player_type: str = "player_type") -> DataFrame:
    """rows: one JSON object text per player and its list type."""
    r, kind = F.col(row), F.col(player_type)
    pitcher = kind == "PITCHER"

    def field(name: str) -> Column:
        return json_path(r, f"$.{name}")

    def stat(name: str) -> Column:
        hit, pit = HITTER_STATS.get(name), PITCHER_STATS.get(name)
        value = F.when(pitcher, field(pit) if pit else F.lit(None)).otherwise(field(hit) if hit else F.lit(None))
        number = value.try_cast("double")
        if name in RATES_3:
            return F.round(number, 3)
        if name in RATES_2:
            return F.round(number, 2)
        return number.cast("int")

    position = F.trim(json_path(field("profile"), "$.position"))
    innings = F.when(pitcher, field("pitcherInning"))
    stats = F.struct(
        *[stat(c).alias(c) for c in STAT_COLUMNS], innings.alias("innings"), V.parse_innings(innings).alias("innings_value")
    )
    text = F.lit("")
    return rows.select(
        *[c for c in rows.columns if c not in (row, player_type)],
        F.coalesce(field("playerId"), text).alias("player_id"),
        F.coalesce(field("playerName"), text).alias("name"),
        F.coalesce(field("teamId"), text).alias("team_code"),
        kind.alias("player_type"),
        F.coalesce(F.nullif(position, text), F.when(pitcher, F.lit(PITCHER_POSITION)).otherwise(F.lit(HITTER_POSITION))).alias("position"),
        field("backNumber").try_cast("int").alias("back_number"),
        field("height").try_cast("int").alias("height_cm"),
        field("weight").try_cast("int").alias("weight_kg"),
        F.coalesce(field("isQualified").isin("true", "1"), F.lit(False)).alias("is_qualified"),
        F.coalesce(field("isRetire") == "Y", F.lit(False)).alias("is_retired"),
        field("ranking").try_cast("int").alias("league_rank"),
        stats.alias("stats"),
    )


def flatten_players(responses: DataFrame, *, payload: str = "payload") -> Feed:
    """responses: player_type, payload. Empty lists are quarantined like broken envelopes."""
    p = F.col(payload)
    items = F.from_json(json_path(p, "$.result.seasonPlayerStats"), "array<string>")
    ok = F.coalesce(json_path(p, "$.success") == "true", F.lit(False))
    problem = F.when(~ok, F.lit("not_successful")).when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("no_players"))
    good, bad = _split(responses.withColumn("problem", problem))
    rows = good.select("player_type", F.posexplode(items).alias("arrival", "row"))
    return Feed(normalize_players(rows), bad)


VIDEO_DDL = (
    "struct<items:array<struct<id:string, snippet:struct<title:string, channelTitle:string, publishedAt:string, "
    "thumbnails:struct<medium:struct<url:string>, `default`:struct<url:string>>>, contentDetails:struct<duration:string>, "
    "status:struct<embeddable:boolean>>>>"
)
PLAYLIST_DDL = (
    "struct<items:array<struct<snippet:struct<title:string, channelTitle:string, videoOwnerChannelTitle:string, "
    "resourceId:struct<videoId:string>>, contentDetails:struct<videoPublishedAt:string>>>>"
)


def _items(responses: DataFrame, payload: str, ddl: str, missing: Column, problem: str) -> tuple[DataFrame, DataFrame]:
    parsed = responses.withColumn("_items", F.from_json(F.col(payload), ddl)["items"])
    why = F.when(F.col("_items").isNull(), F.lit("items_not_list")).when(missing, F.lit(problem))
    return _split(parsed.withColumn("problem", why))


def flatten_videos(responses: DataFrame, *, payload: str = "payload") -> Feed:
    """A response item without status.embeddable means the upstream form changed: the response is quarantined."""
    missing = F.exists("_items", lambda i: i["status"]["embeddable"].isNull())
    good, bad = _items(responses, payload, VIDEO_DDL, missing, "embeddable_missing")
    one = good.select(*[c for c in responses.columns if c != payload], F.explode("_items").alias("v"))
    seconds = V.parse_duration(F.col("v.contentDetails.duration"))
    blank = F.lit("")
    rows = one.where(F.col("v.id").isNotNull()).select(
        *[c for c in responses.columns if c != payload],
        F.col("v.id").alias("id"),
        F.coalesce("v.snippet.title", blank).alias("title"),
        F.coalesce("v.snippet.channelTitle", blank).alias("channel_title"),
        V.kst_date(F.col("v.snippet.publishedAt")).alias("published_at"),
        F.coalesce("v.snippet.publishedAt", blank).alias("published_at_utc"),
        seconds.cast("int").alias("duration_seconds"),
        V.format_duration(seconds).alias("duration"),
        F.col("v.status.embeddable").alias("embeddable"),
        F.coalesce("v.snippet.thumbnails.medium.url", "v.snippet.thumbnails.default.url").alias("thumbnail_url"),
        F.concat(F.lit(WATCH_URL), "v.id").alias("url"),
    )
    return Feed(rows, bad.drop("_items"))


def flatten_playlist(responses: DataFrame, *, payload: str = "payload") -> Feed:
    """responses: playlist_id, payload. Deleted, private and unpublished items are skipped."""
    missing = F.exists("_items", lambda i: i["snippet"]["resourceId"].isNull())
    good, bad = _items(responses, payload, PLAYLIST_DDL, missing, "resource_missing")
    one = good.select(*[c for c in responses.columns if c != payload], F.posexplode("_items").alias("arrival", "v"))
    published = V.kst_date(F.col("v.contentDetails.videoPublishedAt"))
    rows = one.select(
        *[c for c in responses.columns if c != payload],
        "arrival",
        F.col("v.snippet.resourceId.videoId").alias("id"),
        F.coalesce("v.snippet.title", F.lit("")).alias("title"),
        F.coalesce(F.nullif(F.col("v.snippet.videoOwnerChannelTitle"), F.lit("")), "v.snippet.channelTitle", F.lit("")).alias("channel_title"),
        published.alias("published_at"),
        F.col("v.contentDetails.videoPublishedAt").alias("published_at_utc"),
    ).where(F.col("id").rlike(V.VIDEO_ID) & ~F.col("title").isin(*SKIPPED_TITLES) & F.col("published_at").isNotNull())
    return Feed(rows, bad.drop("_items"))
