"""Feed queries: given tables wrapped into the upstream JSON responses, some of them broken, and flattened again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import values as V
from corvane.sources import feeds
from driver_queries.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def response(key: str, result: Column) -> Column:
    """A response; some say they failed, some are no JSON, some hold text where the result belongs."""
    k = F.col(key)
    good = F.to_json(F.struct(F.lit(200).alias("code"), (k % 7 != 3).alias("success"), result.alias("result")))
    odd = F.to_json(F.struct(F.lit(200).alias("code"), F.lit(True).alias("success"), F.lit("none").alias("result")))
    return F.when(k % 11 == 5, F.lit("<html>")).when(k % 13 == 6, odd).otherwise(good)


def good_sql(key: str) -> str:
    return f"{key} % 7 <> 3 AND {key} % 11 <> 5 AND {key} % 13 <> 6"


def responses(rows: DataFrame, key: str, items: str, item: Column, **more: Column) -> DataFrame:
    """One response for each key."""
    grouped = rows.groupBy(key).agg(F.collect_list(item).alias("_items"), F.count(F.lit(1)).alias("_n"))
    result = F.struct(F.col("_items").alias(items), *[c.alias(n) for n, c in more.items()])
    return grouped.select(key, response(key, result).alias("payload"))


@R.add(
    "schedule_feed",
    f"""SELECT o_orderkey::VARCHAR AS game_id, o_orderdate::DATE AS game_date, o_orderdate::DATE + INTERVAL 1 HOUR * (o_orderkey % 24) AS game_date_time,
    concat('N', o_custkey) AS home_code, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x' END AS home_name, (o_orderkey % 9)::INT AS home_score, o_orderkey % 13 = 0 AS cancel,
    (count(*) OVER (PARTITION BY o_custkey))::INT AS total FROM orders WHERE {good_sql('o_custkey')}""",
)
def schedule_feed(spark, sf):
    """A customer's orders as one response with games."""
    o = F.col("o_orderkey")
    time = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'"), F.lpad((o % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    game = F.struct(
        o.cast("string").alias("gameId"), F.date_format("o_orderdate", "yyyyMMdd").alias("gameDate"), time.alias("gameDateTime"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("homeTeamCode"),
        F.when(o % 3 != 0, F.lit("x")).alias("homeTeamName"), (o % 9).alias("homeTeamScore"), (o % 13 == 0).alias("cancel"),
    )
    asked = responses(table(spark, sf, "orders"), "o_custkey", "games", game, gameTotalCount=F.col("_n")).withColumn("as_of", F.lit("2026-09-15"))
    rows = feeds.flatten_schedule(asked).rows
    return rows.select("game_id", "game_date", "game_date_time", "home_code", "home_name", "home_score", "cancel", "total")


@R.add(
    "feed_quarantine",
    """SELECT o_custkey, CASE WHEN o_custkey % 11 = 5 THEN 'not_successful' WHEN o_custkey % 13 = 6 THEN 'result_not_object' ELSE 'not_successful' END AS problem
    FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 11 = 5 OR o_custkey % 13 = 6 OR o_custkey % 7 = 3""",
)
def feed_quarantine(spark, sf):
    """The responses that could not be read, and why."""
    asked = responses(table(spark, sf, "orders"), "o_custkey", "seasonTeamStats", F.struct(F.lit("t").alias("teamId")))
    found = feeds.flatten_standings(asked.withColumn("season", F.lit(2026)).withColumn("as_of", F.lit("2026-09-15"))).quarantine
    return found.select("o_custkey", "problem")


@R.add(
    "standings_feed",
    f"""SELECT s_nationkey::INT AS season, 'REGULAR_SEASON' AS game_type, s_suppkey::VARCHAR AS team_id, s_name AS team_name, (s_suppkey % 10)::INT AS ranking, (s_suppkey % 1000 / 1000.0)::DOUBLE AS wra,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 144)::INT END AS games FROM supplier WHERE {good_sql('s_nationkey')}""",
)
def standings_feed(spark, sf):
    """A nation's suppliers as the standings of a season."""
    s = F.col("s_suppkey")
    team = F.struct(
        s.cast("string").alias("teamId"), F.col("s_name").alias("teamName"), (s % 10).alias("ranking"), (s % 1000 / 1000.0).alias("wra"),
        F.when(s % 4 != 0, s % 144).alias("gameCount"),
    )
    asked = responses(table(spark, sf, "supplier"), "s_nationkey", "seasonTeamStats", team)
    rows = feeds.flatten_standings(asked.select(F.col("s_nationkey").cast("int").alias("season"), F.lit("d").alias("as_of"), "payload")).rows
    return rows.select("season", "game_type", "team_id", "team_name", "ranking", "wra", "games")


@R.add(
    "players_feed",
    f"""SELECT c_custkey::VARCHAR AS player_id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'PITCHER' ELSE 'HITTER' END AS player_type,
    CASE WHEN c_custkey % 3 = 0 THEN '포수' WHEN c_nationkey % 2 = 0 THEN '투수' ELSE '야수' END AS position, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 100)::INT END AS back_number, c_custkey % 5 = 0 AS is_qualified, c_custkey % 6 = 0 AS is_retired,
    CASE WHEN c_nationkey % 2 = 1 THEN round((c_custkey % 10000 / 10000.0)::DOUBLE, 3) END AS avg, CASE WHEN c_nationkey % 2 = 0 THEN round((c_custkey % 777 / 100.0)::DOUBLE, 2) END AS era,
    CASE WHEN c_nationkey % 2 = 0 THEN (c_custkey % 200 + c_custkey % 2 / 3.0)::DOUBLE END AS innings_value FROM customer WHERE c_nationkey % 7 <> 3""".replace("(c_custkey % 200 + c_custkey % 2 / 3.0)::DOUBLE", "(c_custkey % 200 + round(c_custkey % 2 / 3.0, 3))::DOUBLE"),
)
def players_feed(spark, sf):
    """A nation's customers as one list of pitchers or hitters."""
    c, nation = F.col("c_custkey"), F.col("c_nationkey")
    pitcher = nation % 2 == 0
    player = F.struct(
        c.cast("string").alias("playerId"), F.col("c_name").alias("playerName"), F.struct(F.when(c % 3 == 0, F.lit(" 포수 ")).otherwise(F.lit("")).alias("position")).alias("profile"),
        F.when(c % 4 != 0, (c % 100).cast("string")).otherwise(F.lit("-")).alias("backNumber"), F.when(c % 5 == 0, F.lit(1)).otherwise(0).alias("isQualified"), F.when(c % 6 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("isRetire"),
        F.when(~pitcher, c % 10000 / 10000.0).alias("hitterHra"), F.when(pitcher, c % 777 / 100.0).alias("pitcherEra"),
        F.when(pitcher, F.concat((c % 200).cast("string"), F.when(c % 2 == 1, F.lit(" 1/3")).otherwise(F.lit("")))).alias("pitcherInning"),
    )
    lists = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list(player).alias("items"))
    body = F.to_json(F.struct((nation % 7 != 3).alias("success"), F.struct(F.col("items").alias("seasonPlayerStats")).alias("result")))
    asked = lists.select(F.when(pitcher, F.lit("PITCHER")).otherwise(F.lit("HITTER")).alias("player_type"), body.alias("payload"))
    rows = feeds.flatten_players(asked).rows
    return rows.select("player_id", "name", "player_type", "position", "back_number", "is_qualified", "is_retired", "stats.avg", "stats.era", "stats.innings_value")


@R.add(
    "videos_feed",
    """SELECT event_id::VARCHAR AS id, concat('title ', event_type) AS title, (ts + INTERVAL 9 HOUR)::DATE AS published_at, (event_id % 3000)::INT AS duration_seconds, event_id % 2 = 0 AS embeddable,
    concat('https://www.youtube.com/watch?v=', event_id) AS url FROM events WHERE user_id % 7 <> 3 AND user_id % 11 <> 5""",
)
def videos_feed(spark, sf):
    """A user's events as one list of videos; lists without the embeddable flag, or without items, are set aside."""
    e, user = F.col("event_id"), F.col("user_id")
    flag = F.struct(F.when(user % 7 != 3, e % 2 == 0).alias("embeddable"))
    item = F.struct(
        e.cast("string").alias("id"), flag.alias("status"), F.struct(F.format_string("PT%dM%dS", F.floor(e % 3000 / 60), e % 60).alias("duration")).alias("contentDetails"),
        F.struct(F.concat(F.lit("title "), F.col("event_type")).alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"),
    )
    lists = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(item).alias("items"))
    asked = lists.select("user_id", F.when(user % 11 == 5, F.lit('{"error": 1}')).otherwise(F.to_json(F.struct("items"))).alias("payload"))
    return feeds.flatten_videos(asked).rows.select("id", "title", "published_at", "duration_seconds", "embeddable", "url")


@R.add(
    "uploads_playlists",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN concat('UU', substr(md5(p_name), 1, 22)) END AS playlist FROM part",
)
def uploads_playlists(spark, sf):
    """Parts as channels, every third under no channel id."""
    channel = F.concat(F.when(F.col("p_partkey") % 3 != 0, F.lit(" UC")).otherwise(F.lit("XX")), F.substring(F.md5("p_name"), 1, 22))
    return table(spark, sf, "part").select("p_partkey", V.uploads_playlist_id(channel).alias("playlist"))
