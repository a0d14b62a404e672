"""Record queries: table upkeep, schedules, rosters, invariants, usage logs, budgets, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import values as V
from corvane.operators import league as G
from corvane.operators import maintain as M
from corvane.operators import media as P
from corvane.operators import usage as U
from corvane.operators.ranking import first_nonempty, top_n_per_group
from corvane.plans import evaluate as E
from corvane.sources.feeds import json_path
from driver_queries.base import Registry, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---------------------------------------------------------------- table upkeep


@R.add("stale_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stale_rows(spark, sf):
    return M.stale_rows(orders(spark, sf).select("o_orderkey"), lineitem(spark, sf).select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@R.add(
    "orphan_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL""",
)
def orphan_rows(spark, sf):
    """Order lines whose order is missing or pending."""
    out = M.orphan_rows(lineitem(spark, sf), orders(spark, sf), "l_orderkey", "o_orderkey", F.col("o_orderstatus") != "P")
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@R.add(
    "registry_diff",
    """SELECT n_nationkey AS code, 'missing' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey + 3 FROM supplier)
    UNION ALL SELECT DISTINCT s_nationkey + 3, 'unknown' FROM supplier WHERE s_nationkey + 3 NOT IN (SELECT n_nationkey FROM nation)""",
)
def registry_diff(spark, sf):
    have = table(spark, sf, "supplier").select((F.col("s_nationkey") + 3).alias("code"))
    return M.registry_diff(table(spark, sf, "nation").select(F.col("n_nationkey").alias("code")), have, "code")


@R.add(
    "upsert",
    """WITH fresh AS (SELECT o_orderkey + 5 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey + 5, o_custkey + 1, 'M', o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0),
    newest AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) = 1)
    SELECT o_orderkey, o_custkey, o_orderstatus FROM newest UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM newest)""",
)
def upsert(spark, sf):
    old = orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    done = old.where(F.col("o_orderstatus") == "F").withColumn("o_orderkey", F.col("o_orderkey") + 5)
    later = done.where(F.col("o_custkey") % 2 == 0).withColumns(
        {"o_custkey": F.col("o_custkey") + 1, "o_orderstatus": F.lit("M"), "o_orderdate": F.col("o_orderdate") + F.expr("interval 1 day")}
    )
    new = done.withColumn("o_orderstatus", F.lit("N")).unionByName(later)
    return M.upsert(old, new, ["o_orderkey"], version=F.col("o_orderdate")).select("o_orderkey", "o_custkey", "o_orderstatus")


@R.add("activate", "SELECT n_name AS id, CASE WHEN n_nationkey % 5 = 0 OR n_name = 'NATION_7' THEN n_name = 'NATION_7' ELSE false END AS active FROM nation")
def activate(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 5 == 0).alias("active"))
    return M.activate(rows, "NATION_7")


@R.add("prune_inactive", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def prune_inactive(spark, sf):
    parents = orders(spark, sf).select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("active"))
    _, kept = M.prune_inactive(parents, lineitem(spark, sf), parent="l_orderkey")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@R.add("retain_latest", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events QUALIFY rank <= 3")
def retain_latest(spark, sf):
    rows = events(spark, sf).select("event_type", "event_id", "ts")
    return M.retain_latest(rows, kind="event_type", at="ts", tie="event_id").drop("ts")


@R.add("latest_snapshot", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", "event_type", "ts")
    return M.latest_snapshot(rows, kind="user_id", at="ts", tie="event_id").select("user_id", "event_id", "event_type")


@R.add(
    "cache_freshness",
    """WITH cache AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    asks AS (SELECT event_id, user_id + user_id % 3 AS user_id FROM events WHERE event_type = 'click')
    SELECT asks.event_id, asks.user_id, CASE WHEN cache.ts IS NULL THEN 'unavailable' WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts) > 86400000000 THEN 'stale' ELSE 'cached' END AS freshness
    FROM asks LEFT JOIN cache ON cache.user_id = asks.user_id""",
)
def cache_freshness(spark, sf):
    e = events(spark, sf)
    cache = e.where(F.col("event_type") == "view").select("user_id", F.col("ts").alias("fetched_at"), F.lit(86400).alias("ttl_seconds"))
    asks = e.where(F.col("event_type") == "click").select("event_id", (F.col("user_id") + F.col("user_id") % 3).alias("user_id"))
    return M.cache_freshness(asks, cache, at("2024-01-30 12:00:00"), key="user_id").select("event_id", "user_id", "freshness")


@R.add("purge", "SELECT event_id, event_type FROM events WHERE NOT (event_type LIKE 'cl%' AND ts < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY)")
def purge(spark, sf):
    return M.purge(events(spark, sf), at("2024-02-15 00:00:00"), key="event_type", at="ts", prefix="cl").select("event_id", "event_type")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@R.add("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES))
def table_counts(spark, sf):
    return M.table_counts({t: table(spark, sf, t) for t in TABLES})


@R.add(
    "index_report",
    """SELECT (SELECT count(*) FROM orders) AS documents, (SELECT max(o_orderkey::VARCHAR) FROM orders WHERE o_orderstatus = 'O') AS active_version,
    (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O') AS chunks,
    (SELECT count(*) FROM (SELECT n_nationkey::VARCHAR AS c FROM nation UNION SELECT 'KBO') WHERE c NOT IN (SELECT (s_nationkey + 3)::VARCHAR FROM supplier)) AS channels_missing,
    (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey + 3 NOT IN (SELECT n_nationkey FROM nation)) AS channels_unknown""",
)
def index_report(spark, sf):
    key = F.col("o_orderkey").cast("string")
    documents = orders(spark, sf).select(key.alias("id"), key.alias("index_version"), (F.col("o_orderstatus") == "O").alias("active"))
    chunks = lineitem(spark, sf).select(F.col("l_orderkey").cast("string").alias("document_id"))
    teams = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"))
    channels = table(spark, sf, "supplier").select((F.col("s_nationkey") + 3).cast("string").alias("code"))
    return M.index_report(documents, chunks, teams, channels, "KBO")


@R.add("key_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def key_filter(spark, sf):
    wanted = table(spark, sf, "part").where(F.col("p_size") > 45).select(F.col("p_partkey").alias("l_partkey"))
    return lineitem(spark, sf).join(wanted, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@R.add(
    "sibling_join",
    """WITH top AS (SELECT l_suppkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 3),
    s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, (l_quantity * 9)::BIGINT AS tokens, sum((l_quantity * 9)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS used
      FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM top))
    SELECT l_orderkey, l_linenumber, l_partkey, tokens FROM s WHERE used <= 900""",
)
def sibling_join(spark, sf):
    """Lines of the orders holding each supplier's three dearest lines, within 900 tokens per order."""
    from corvane.operators.fusion import sibling_prefix

    rows = lineitem(spark, sf)
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    top = top_n_per_group(rows, ["l_suppkey"], order, 3).select(F.col("l_orderkey").alias("parent_id")).distinct()
    chunks = rows.select(
        F.col("l_orderkey").alias("parent_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("chunk_index"),
        F.lit(0).alias("id"), (F.col("l_quantity") * 9).cast("bigint").alias("tokens"), "l_linenumber", "l_partkey",
    )
    return sibling_prefix(chunks, top).select(F.col("parent_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "tokens")


# ---------------------------------------------------------------- schedules, rosters, teams

GAME_SQL = """
games AS (SELECT o_orderkey AS game_id, o_orderdate::DATE AS game_date, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS game_date_time,
  CASE WHEN o_orderkey % 10 = 9 THEN 'kbo_as' ELSE 'kbo_r' END AS round_code, concat('S', o_orderkey % 7) AS stadium,
  concat('N', o_custkey % 25) AS home_code, concat('N', (o_custkey + 1 + o_orderkey % 24) % 25) AS away_code,
  floor(o_totalprice % 10)::INT AS home_score, CASE o_orderstatus WHEN 'O' THEN 'BEFORE' WHEN 'P' THEN 'STARTED' ELSE 'RESULT' END AS status_code, o_orderkey % 13 = 0 AS cancel FROM orders)
"""
NOW = "1998-06-15 12:00:00"


def games(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as games between nations."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders(spark, sf).select(
        k.alias("game_id"), F.to_date("o_orderdate").alias("game_date"), F.expr("o_orderdate + make_dt_interval(0, o_orderkey % 24)").alias("game_date_time"),
        F.when(k % 10 == 9, F.lit("kbo_as")).otherwise(F.lit("kbo_r")).alias("round_code"), F.concat(F.lit("S"), (k % 7).cast("string")).alias("stadium"),
        F.concat(F.lit("N"), (c % 25).cast("string")).alias("home_code"), F.concat(F.lit("N"), ((c + 1 + k % 24) % 25).cast("string")).alias("away_code"),
        F.floor(F.col("o_totalprice") % 10).cast("int").alias("home_score"),
        F.when(F.col("o_orderstatus") == "O", F.lit("BEFORE")).when(F.col("o_orderstatus") == "P", F.lit("STARTED")).otherwise(F.lit("RESULT")).alias("status_code"),
        (k % 13 == 0).alias("cancel"),
    )


@R.add("remaining_games", f"WITH {GAME_SQL} SELECT game_id, game_date FROM games WHERE round_code = 'kbo_r' AND status_code = 'BEFORE' AND NOT cancel AND game_date >= DATE '1998-06-15'")
def remaining_games(spark, sf):
    return G.remaining(games(spark, sf), F.lit("1998-06-15").cast("date")).select("game_id", "game_date")


@R.add("upcoming_games", f"WITH {GAME_SQL} SELECT game_id, game_date_time FROM games WHERE round_code = 'kbo_r' AND status_code = 'BEFORE' AND NOT cancel AND game_date_time >= TIMESTAMP '{NOW}'")
def upcoming_games(spark, sf):
    return G.upcoming(games(spark, sf), at(NOW)).select("game_id", "game_date_time")


@R.add(
    "last_finished",
    f"""WITH {GAME_SQL} SELECT home_code, game_id, game_date_time FROM games WHERE round_code = 'kbo_r' AND NOT cancel AND game_date_time <= TIMESTAMP '{NOW}' AND status_code IN ('RESULT', 'STARTED')
    QUALIFY row_number() OVER (PARTITION BY home_code ORDER BY game_date_time DESC, game_id DESC) = 1""",
)
def last_finished(spark, sf):
    return G.last_finished(games(spark, sf), at(NOW), "home_code").select("home_code", "game_id", "game_date_time")


@R.add("team_games", f"WITH {GAME_SQL} SELECT game_id, home_code, away_code FROM games WHERE home_code = 'N3' OR away_code = 'N3'")
def team_games(spark, sf):
    return G.for_team(games(spark, sf), "N3").select("game_id", "home_code", "away_code")


@R.add(
    "pick_game",
    f"""WITH {GAME_SQL}, q AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('N', c_nationkey) END AS code, CASE WHEN c_custkey % 3 = 0 THEN concat('S', c_custkey % 7) END AS venue,
      CASE WHEN c_custkey % 2 = 0 THEN 'upcoming' ELSE 'last_finished' END AS prefer FROM customer),
    side AS (SELECT home_code AS code, * FROM games UNION ALL SELECT away_code, * FROM games UNION ALL SELECT '*', * FROM games),
    ok AS (SELECT * FROM side WHERE round_code = 'kbo_r' AND NOT cancel),
    nx AS (SELECT code, stadium, min((game_date_time, game_id)) AS g FROM ok WHERE status_code = 'BEFORE' AND game_date_time >= TIMESTAMP '{NOW}' GROUP BY ALL),
    pv AS (SELECT code, stadium, max((game_date_time, game_id)) AS g FROM ok WHERE status_code <> 'BEFORE' AND game_date_time <= TIMESTAMP '{NOW}' GROUP BY ALL),
    a AS (SELECT qid, min(g) AS g FROM q JOIN nx ON nx.code = coalesce(q.code, '*') AND (q.code IS NULL OR venue IS NULL OR contains(stadium, venue)) GROUP BY qid),
    b AS (SELECT qid, max(g) AS g FROM q JOIN pv ON pv.code = coalesce(q.code, '*') AND (q.code IS NULL OR venue IS NULL OR contains(stadium, venue)) GROUP BY qid)
    SELECT q.qid, CASE WHEN prefer = 'upcoming' THEN CASE WHEN a.g IS NOT NULL THEN 'upcoming' WHEN b.g IS NOT NULL THEN 'last_finished' ELSE 'none' END
        ELSE CASE WHEN b.g IS NOT NULL THEN 'last_finished' WHEN a.g IS NOT NULL THEN 'upcoming' ELSE 'none' END END AS relation,
      CASE WHEN prefer = 'upcoming' THEN coalesce(a.g, b.g) ELSE coalesce(b.g, a.g) END[2] AS game_id FROM q LEFT JOIN a ON a.qid = q.qid LEFT JOIN b ON b.qid = q.qid""".replace("END[2] AS game_id", "END AS gg"),
)
def pick_game(spark, sf):
    k = F.col("c_custkey")
    asks = table(spark, sf, "customer").select(
        k.alias("qid"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))).alias("codes"),
        F.when(k % 3 == 0, F.concat(F.lit("S"), (k % 7).cast("string"))).alias("venue"),
        F.when(k % 2 == 0, F.lit("upcoming")).otherwise(F.lit("last_finished")).alias("prefer"),
    )
    return G.pick_game(asks, games(spark, sf), at(NOW)).select("qid", "relation", F.col("game.game_id").alias("game_id"))


SQL["pick_game"] = f"WITH x AS ({SQL['pick_game']}) SELECT qid, relation, struct_extract_at(gg, 2) AS game_id FROM x"


@R.add(
    "schedule_top",
    f"""WITH {GAME_SQL}, r AS (SELECT * FROM games WHERE round_code = 'kbo_r' AND status_code = 'BEFORE' AND NOT cancel AND game_date >= DATE '1998-06-15'),
    t AS (SELECT home_code, game_id, row_number() OVER (PARTITION BY home_code ORDER BY game_date_time, game_id)::INT AS place, count(*) OVER (PARTITION BY home_code) AS total FROM r)
    SELECT home_code, game_id, place, total, CASE WHEN total > 10 THEN concat('남은 경기 ', total, '경기 (가까운 10경기만 표시)') ELSE concat('남은 경기 ', total, '경기') END AS head FROM t WHERE place <= 10""",
)
def schedule_top(spark, sf):
    left = G.remaining(games(spark, sf), F.lit("1998-06-15").cast("date"))
    top = G.roster_top(left, ["home_code"], [F.col("game_date_time"), F.col("game_id")], G.SCHEDULE_LINES)
    return top.select("home_code", "game_id", "place", "total", G.schedule_head(F.col("total"), G.SCHEDULE_LINES).alias("head"))


@R.add(
    "schedule_lines",
    f"""WITH {GAME_SQL} SELECT game_id, concat(strftime(game_date_time, '%Y-%m-%d(%a) %H:%M '), coalesce(a.n_name, away_code), ' vs ',
      coalesce(h.n_name, home_code), ' ', stadium) AS line FROM games
    LEFT JOIN nation h ON home_code = concat('N', h.n_nationkey + 5) LEFT JOIN nation a ON away_code = concat('N', a.n_nationkey + 5)""",
)
def schedule_lines(spark, sf):
    """Nations as teams under shifted codes, so that some games have teams nobody knows."""
    teams = table(spark, sf, "nation").select(F.concat(F.lit("N"), (F.col("n_nationkey") + 5).cast("string")).alias("code"), F.col("n_name").alias("short"))
    return G.schedule_lines(games(spark, sf), teams).select("game_id", "line")


@R.add(
    "game_lines",
    f"""WITH {GAME_SQL} SELECT game_id, concat('yt:hl:', game_date, ':', away_code, ':', home_code) AS game_key,
    CASE WHEN status_code = 'BEFORE' THEN concat(month(game_date), '월 ', day(game_date), '일', strftime(game_date_time, ' %H:%M '), away_code, ' 대 ', home_code, ' (', stadium, ')')
      ELSE concat(month(game_date), '월 ', day(game_date), '일 ', away_code, ' 대 ', home_code, CASE WHEN status_code = 'RESULT' THEN concat(' 3-', home_score) ELSE '' END, ' (', stadium, ')') END AS line,
    concat_ws(' ', away_code, home_code, concat(month(game_date), '월 ', day(game_date), '일'), '야구 하이라이트') AS query FROM games""",
)
def game_lines(spark, sf):
    g = games(spark, sf)
    relation = F.when(F.col("status_code") == "BEFORE", F.lit("upcoming")).otherwise(F.lit("last_finished"))
    line = V.game_line(relation, F.col("game_date_time"), F.col("away_code"), F.col("home_code"), F.col("stadium"), F.col("status_code"), F.lit(3), F.col("home_score"))
    return g.select(
        "game_id", V.game_key(F.col("game_date"), F.col("away_code"), F.col("home_code")).alias("game_key"), line.alias("line"),
        V.highlight_query(F.col("game_date"), F.col("home_code"), F.col("away_code")).alias("query"),
    )


@R.add("team_info", "SELECT n_name, n_regionkey, r_name FROM nation LEFT JOIN region ON r_regionkey + 2 = n_regionkey")
def team_info(spark, sf):
    """Nations with a region's row standing for the current standing; shifted keys leave some without."""
    teams = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("code"), "n_name", "n_regionkey")
    null = F.lit(None)
    now = table(spark, sf, "region").select(
        (F.col("r_regionkey") + 2).cast("string").alias("team_id"), F.col("r_name").alias("last_five"),
        *[null.cast("int").alias(c) for c in ("ranking", "wins", "losses", "draws")], *[null.cast("double").alias(c) for c in ("wra", "game_behind")],
    )
    return G.team_info(teams, now).select("n_name", "n_regionkey", F.col("last_five").alias("r_name"))


@R.add(
    "roster_counts",
    """SELECT c_nationkey::VARCHAR AS team_code, count(*) FILTER (c_mktsegment IN ('HOUSEHOLD', 'FURNITURE')) AS hitters,
    count(*) FILTER (c_mktsegment NOT IN ('HOUSEHOLD', 'FURNITURE')) AS pitchers, count(*) AS players FROM customer GROUP BY c_nationkey""",
)
def roster_counts(spark, sf):
    return G.roster_counts(players(spark, sf))


def players(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as players of their nation."""
    kind = F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), F.lit("HITTER")).otherwise(F.lit("PITCHER"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("team_code"), kind.alias("player_type"),
        F.struct(F.floor("c_acctbal").cast("int").alias("games")).alias("stats"), (F.col("c_custkey") % 11 == 0).alias("is_retired"),
    )


@R.add(
    "roster_top",
    """WITH p AS (SELECT c_nationkey::VARCHAR AS team_code, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'HITTER' ELSE 'PITCHER' END AS player_type, c_name AS name, floor(c_acctbal) AS g FROM customer WHERE c_custkey % 11 <> 0),
    r AS (SELECT *, row_number() OVER w::INT AS place, count(*) OVER (PARTITION BY team_code, player_type) AS total FROM p WINDOW w AS (PARTITION BY team_code, player_type ORDER BY g DESC, name))
    SELECT team_code, player_type, name, place, greatest(total - 14, 0) AS others FROM r WHERE place <= 14""",
)
def roster_top(spark, sf):
    top = G.roster_top(G.roster(players(spark, sf)), ["team_code", "player_type"], [F.desc("stats.games"), F.col("name")])
    return top.select("team_code", "player_type", "name", "place", "others")


@R.add(
    "dedupe_best",
    """WITH p AS (SELECT user_id AS player_id, event_id AS arrival, CASE WHEN user_id % 4 = 0 THEN '투수' ELSE '야수' END AS position, CASE WHEN event_type IN ('click', 'view') THEN 'PITCHER' ELSE 'HITTER' END AS player_type, floor(value)::INT AS games FROM events)
    SELECT player_id, player_type, games, arrival FROM p QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY (player_type = CASE WHEN position = '투수' THEN 'PITCHER' ELSE 'HITTER' END) DESC, games DESC, player_type, arrival) = 1""",
)
def dedupe_best(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "view"), F.lit("PITCHER")).otherwise(F.lit("HITTER"))
    rows = events(spark, sf).select(
        F.col("user_id").alias("player_id"), F.col("event_id").alias("arrival"), F.when(F.col("user_id") % 4 == 0, F.lit("투수")).otherwise(F.lit("야수")).alias("position"),
        kind.alias("player_type"), F.struct(F.floor("value").cast("int").alias("games")).alias("stats"),
    )
    return G.dedupe_players(rows).select("player_id", "player_type", F.col("stats.games").alias("games"), "arrival")


STAND_SQL = """
stand AS (SELECT s_suppkey % 7 AS season, (s_suppkey // 7 + CASE WHEN s_suppkey % 97 = 5 THEN 1 ELSE 0 END)::BIGINT AS ranking,
  (100000 - 10 * (s_suppkey // 7) + CASE WHEN s_suppkey % 7 < 3 THEN round(s_acctbal)::BIGINT % 15 ELSE 0 END)::BIGINT AS wra, s_suppkey % 40 AS wins, s_suppkey * 7 % 40 AS losses FROM supplier)
"""


def season_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as the teams of seven seasons, a few of them ranked or rated out of order."""
    k = F.col("s_suppkey")
    place = F.floor(k / 7)
    return table(spark, sf, "supplier").select(
        (k % 7).alias("season"), (place + F.when(k % 97 == 5, 1).otherwise(0)).alias("ranking"),
        (100000 - 10 * place + F.when(k % 7 < 3, F.round("s_acctbal").cast("bigint") % 15).otherwise(0)).alias("wra"),
        (k % 40).alias("wins"), (k * 7 % 40).alias("losses"), F.lit("REGULAR_SEASON").alias("game_type"),
    )


@R.add(
    "season_shape",
    f"""WITH {STAND_SQL}, r AS (SELECT season, ranking, min(wra) AS lo, max(wra) AS hi FROM stand GROUP BY ALL),
    c AS (SELECT a.season, bool_and(b.hi IS NULL OR b.hi <= a.lo) AS rank_ok FROM r a LEFT JOIN r b ON b.season = a.season AND b.ranking = a.ranking + 1 GROUP BY a.season)
    SELECT season, count(*) AS teams, count(DISTINCT ranking) AS ranks, min(ranking) AS low, max(ranking) AS high, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, true AS regular, any_value(rank_ok) AS rank_ok
    FROM stand JOIN c USING (season) GROUP BY season""",
)
def season_shape(spark, sf):
    return G.season_shape(season_rows(spark, sf))


@R.add(
    "validate_games",
    f"""WITH {GAME_SQL}, v AS (SELECT concat(strftime(game_date, '%Y%m%d'), 'AA', 'BB', lpad((game_id % 100000)::VARCHAR, 5, '0')) AS gid, CASE WHEN game_id % 6 = 0 THEN 'AA' ELSE 'LG' END AS away, CASE WHEN game_id % 4 = 0 THEN 'LG' ELSE 'BB' END AS home,
      game_date, game_date_time + INTERVAL 6 HOUR AS dt, status_code, home_score, round_code, game_id FROM games)
    SELECT gid AS row_key, u.code, u.level FROM (SELECT gid, unnest([
      CASE WHEN away <> 'AA' OR home <> 'BB' THEN {{'code': 'SIDES_SWAPPED', 'level': 'fatal'}} END, CASE WHEN away = home THEN {{'code': 'SAME_TEAM', 'level': 'soft'}} END,
      CASE WHEN game_date <> dt::DATE THEN {{'code': 'DATE_MISMATCH', 'level': 'fatal'}} END, CASE WHEN status_code = 'BEFORE' AND home_score <> 0 THEN {{'code': 'SCORE_BEFORE_START', 'level': 'fatal'}} END,
      CASE WHEN round_code = 'kbo_r' AND NOT (home = 'LG' AND away = 'LG') THEN {{'code': 'UNKNOWN_TEAM', 'level': 'fatal'}} END]) AS u FROM v) WHERE u IS NOT NULL
    UNION ALL SELECT '2026-09-15', 'COUNT_MISMATCH', 'fatal'""",
)
def validate_games(spark, sf):
    g, k = games(spark, sf), F.col("game_id")
    rows = g.select(
        F.concat(F.date_format("game_date", "yyyyMMdd"), F.lit("AABB"), F.lpad((k % 100000).cast("string"), 5, "0")).alias("game_id"),
        F.when(k % 6 == 0, F.lit("AA")).otherwise(F.lit("LG")).alias("away_code"), F.when(k % 4 == 0, F.lit("LG")).otherwise(F.lit("BB")).alias("home_code"),
        "game_date", (F.col("game_date_time") + F.expr("interval 6 hours")).alias("game_date_time"), "status_code", "home_score", F.lit(0).alias("away_score"), "round_code",
        F.lit("2026-09-15").alias("as_of"), F.lit(7).alias("total"),
    )
    return G.validate_games(rows)


@R.add(
    "validate_orders",
    """WITH l AS (SELECT l_orderkey AS season, l_partkey::VARCHAR AS team_id, l_linenumber AS ranking, l_discount * 12 AS wra, l_quantity::INT AS games, l_suppkey::INT % 20 AS wins, l_partkey::INT % 20 AS losses FROM lineitem),
    r AS (SELECT season, ranking, min(wra) AS lo, max(wra) AS hi FROM l GROUP BY ALL),
    c AS (SELECT a.season, bool_and(b.hi IS NULL OR b.hi <= a.lo) AS rank_ok FROM r a LEFT JOIN r b ON b.season = a.season AND b.ranking = a.ranking + 1 GROUP BY a.season),
    t AS (SELECT season, count(*) AS teams, count(DISTINCT ranking) AS ranks, min(ranking) AS low, max(ranking) AS high, sum(wins) AS wins, sum(losses) AS losses, any_value(rank_ok) AS rank_ok
      FROM l JOIN c USING (season) GROUP BY season)
    SELECT concat_ws(':', season, team_id) AS row_key, u.code, u.level FROM (SELECT season, team_id, unnest([
      {'code': 'UNKNOWN_TEAM', 'level': 'fatal'}, CASE WHEN wra > 1 THEN {'code': 'WRA_RANGE', 'level': 'fatal'} END, CASE WHEN games <> wins + losses + 1 THEN {'code': 'GAMES_SUM', 'level': 'fatal'} END,
      CASE WHEN wins + losses > 0 AND abs(wra - wins / (wins + losses)) > 0.0015 THEN {'code': 'WRA_DEFINITION', 'level': 'fatal'} END]) AS u FROM l) WHERE u IS NOT NULL
    UNION ALL SELECT season::VARCHAR, u.code, u.level FROM (SELECT season, unnest([
      CASE WHEN teams <> 10 THEN {'code': 'TEAM_COUNT', 'level': 'fatal'} END, CASE WHEN ranks <> 10 OR low <> 1 OR high <> 10 THEN {'code': 'RANK_PERMUTATION', 'level': 'fatal'} END,
      CASE WHEN NOT rank_ok THEN {'code': 'RANK_ORDER', 'level': 'fatal'} END, CASE WHEN wins <> losses THEN {'code': 'WINS_LOSSES', 'level': 'fatal'} END]) AS u FROM t) WHERE u IS NOT NULL""",
)
def validate_orders(spark, sf):
    """Order lines as standing rows, orders as seasons: violations of rows and of whole tables."""
    rows = lineitem(spark, sf).select(
        F.col("l_orderkey").alias("season"), F.col("l_partkey").cast("string").alias("team_id"), F.col("l_linenumber").alias("ranking"), (F.col("l_discount") * 12).alias("wra"),
        F.col("l_quantity").cast("int").alias("games"), (F.col("l_suppkey").cast("int") % 20).alias("wins"), (F.col("l_partkey").cast("int") % 20).alias("losses"), F.lit(1).alias("draws"),
        F.lit("WLW").alias("last_five"), F.lit("k").alias("keyword"), F.lit("REGULAR_SEASON").alias("game_type"),
    )
    return G.validate_standings(rows)


@R.add(
    "known_status",
    """SELECT user_id, count(*) AS rows, round(avg((event_type IN ('click', 'view', 'purchase', 'signup'))::INT), 6) AS known_ratio,
    avg((event_type IN ('click', 'view', 'purchase', 'signup'))::INT) >= 0.8 AS ok FROM events GROUP BY user_id""",
)
def known_status(spark, sf):
    return G.known_status_ratio(events(spark, sf), ["user_id"], "event_type", ("click", "view", "purchase", "signup"), 0.8)


# ---------------------------------------------------------------- videos


VIDEO_SQL = """
g AS (SELECT o_orderkey AS game_id, concat('N', o_custkey) AS code, DATE '2024-01-01' + (o_orderkey % 30)::INT AS game_date FROM orders),
    v AS (SELECT event_id AS id, concat('N', user_id) AS code, (ts + INTERVAL 9 HOUR)::DATE AS published_at, CASE event_id % 3 WHEN 0 THEN concat('[H/L] ', month(ts), '.', day(ts), ' game') WHEN 1 THEN concat('1월 ', 1 + event_id % 28, '일 highlight') ELSE 'preview' END AS title FROM events),
    d AS (SELECT *, month(game_date) AS m, day(game_date) AS dd FROM g),
pairs AS (SELECT game_id, id, title, published_at, game_date, m, dd FROM d JOIN v ON v.code = d.code AND ((published_at >= game_date AND published_at <= game_date + 2) OR (published_at >= game_date AND published_at <= game_date + 30) AND (contains(title, concat(m, '.', dd)) OR contains(title, concat(lpad(m::VARCHAR, 2, '0'), '.', lpad(dd::VARCHAR, 2, '0')))
      OR contains(title, concat(m, '월 ', dd, '일')) OR contains(title, concat(m, '월', dd, '일')))))
"""


@R.add(
    "interval_match",
    f"WITH {VIDEO_SQL} SELECT game_id, id FROM pairs",
)
def interval_match(spark, sf):
    g, v = videos_of_games(spark, sf)
    return P.match_videos(g, v).select("game_id", "id")


def videos_of_games(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Orders as January games of a customer and events as uploads of the user with that number."""
    g = orders(spark, sf).select(
        F.col("o_orderkey").alias("game_id"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("code"), F.lit(0).alias("priority"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("game_date"),
        F.lit("one").alias("home_name"), F.lit("two").alias("away_name"),
    )
    e = F.col("event_id")
    title = (
        F.when(e % 3 == 0, F.concat(F.lit("[H/L] "), F.month("ts").cast("string"), F.lit("."), F.dayofmonth("ts").cast("string"), F.lit(" game")))
        .when(e % 3 == 1, F.concat(F.lit("1월 "), (1 + e % 28).cast("string"), F.lit("일 highlight")))
        .otherwise(F.lit("preview"))
    )
    v = events(spark, sf).select(e.alias("id"), F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("code"), V.kst_day(F.col("ts")).alias("published_at"), title.alias("title"))
    return g, v


@R.add(
    "video_scores",
    """WITH v AS (SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE AS pub, DATE '2024-01-01' + (event_id % 30)::INT AS gd, CASE event_id % 4 WHEN 0 THEN concat('[H/L] ', month(ts), '.', day(ts), ' one vs two') WHEN 1 THEN '하이라이트 one' WHEN 2 THEN 'one two preview' ELSE 'two' END AS title, user_id % 2 = 0 AS trusted, user_id % 3 = 0 AS need FROM events),
    f AS (SELECT *, regexp_matches(title, 'H/L|하이라이트') AS kw, contains(title, concat(month(gd), '.', day(gd))) OR contains(title, concat(lpad(month(gd)::VARCHAR, 2, '0'), '.', lpad(day(gd)::VARCHAR, 2, '0'))) AS tok, pub >= gd AND pub <= gd + 2 AS win, contains(title, 'one') AS h, contains(title, 'two') AS a, contains(title, 'preview') AS ex FROM v)
    SELECT event_id, (CASE WHEN ex OR NOT (tok OR win) OR NOT (tok OR kw) OR (need AND NOT (h AND a)) OR (NOT trusted AND (NOT kw OR NOT (h OR a))) THEN 0
      ELSE trusted::INT + kw::INT + tok::INT + win::INT + CASE WHEN h AND a THEN 2 WHEN h OR a THEN 1 ELSE 0 END END)::INT AS score FROM f""",
)
def video_scores(spark, sf):
    e = F.col("event_id")
    title = (
        F.when(e % 4 == 0, F.concat(F.lit("[H/L] "), F.month("ts").cast("string"), F.lit("."), F.dayofmonth("ts").cast("string"), F.lit(" one vs two")))
        .when(e % 4 == 1, F.lit("하이라이트 one")).when(e % 4 == 2, F.lit("one two preview")).otherwise(F.lit("two"))
    )
    rows = events(spark, sf).withColumn("title", title).withColumn("game_date", F.date_add(F.lit("2024-01-01").cast("date"), (e % 30).cast("int")))
    score = P.video_score(
        F.col("title"), V.kst_day(F.col("ts")), F.col("game_date"), F.contains(F.col("title"), F.lit("one")), F.contains(F.col("title"), F.lit("two")),
        F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0,
    )
    return rows.select("event_id", score.alias("score"))


@R.add(
    "channel_order",
    """WITH g AS (SELECT concat_ws(':', l_orderkey, l_linenumber) AS game_id, concat('N', l_suppkey % 25) AS h, concat('N', l_partkey % 30) AS a FROM lineitem)
    SELECT game_id, priority::INT AS priority, code FROM (SELECT game_id, 0 AS priority, h AS code FROM g UNION ALL SELECT game_id, 1, a FROM g WHERE a <> h
      UNION ALL SELECT game_id, CASE WHEN a = h THEN 1 ELSE 2 END, 'KBO' FROM g) WHERE code = 'KBO' OR code IN (SELECT concat('N', n_nationkey) FROM nation)""",
)
def channel_order(spark, sf):
    g = lineitem(spark, sf).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("game_id"), F.concat(F.lit("N"), (F.col("l_suppkey") % 25).cast("string")).alias("home_code"), F.concat(F.lit("N"), (F.col("l_partkey") % 30).cast("string")).alias("away_code")
    )
    codes = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    return P.channel_order(g, codes.unionByName(codes.limit(1).select(F.lit("KBO").alias("code"))))


@R.add("date_tokens", "SELECT o_orderkey, concat_ws('|', concat(month(d), '.', day(d)), strftime(d, '%m.%d'), concat(month(d), '/', day(d)), strftime(d, '%m/%d'), concat(month(d), '월 ', day(d), '일'), concat(month(d), '월', day(d), '일')) AS tokens FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)")
def date_tokens(spark, sf):
    return orders(spark, sf).select("o_orderkey", F.array_join(V.date_tokens(F.col("o_orderdate")), "|").alias("tokens"))


@R.add(
    "first_nonempty",
    """WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS pr FROM events WHERE value > 480)
    SELECT user_id, event_id, pr AS priority FROM p WHERE pr = (SELECT min(pr) FROM p q WHERE q.user_id = p.user_id)""",
)
def first_nonempty_query(spark, sf):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    rows = events(spark, sf).select("user_id", "event_id", "value", rank.alias("priority"))
    return first_nonempty(rows, ["user_id"], "priority", F.col("value") > 480).drop("value")


# ---------------------------------------------------------------- usage logs and budgets


@R.add(
    "turn_cost",
    """WITH u AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'gpt-4o-mini' WHEN 'view' THEN 'gpt-5.6-luna' ELSE 'other' END AS model, sum(floor(value * 10)::BIGINT)::BIGINT AS input_tokens,
      sum(floor(value)::BIGINT)::BIGINT AS output_tokens, sum(floor(value * 3)::BIGINT)::BIGINT AS cache_read FROM events GROUP BY ALL)
    SELECT *, round(greatest(input_tokens - cache_read, 0) / 1e6 * CASE model WHEN 'gpt-5.6-luna' THEN 0.20 ELSE 0.15 END + cache_read / 1e6 * CASE model WHEN 'gpt-5.6-luna' THEN 0.02 ELSE 0.075 END
      + output_tokens / 1e6 * CASE model WHEN 'gpt-5.6-luna' THEN 1.2 ELSE 0.6 END, 6) AS cost_usd FROM u""",
)
def turn_cost(spark, sf):
    model = F.when(F.col("event_type") == "click", F.lit("gpt-4o-mini")).when(F.col("event_type") == "view", F.lit("gpt-5.6-luna")).otherwise(F.lit("other"))
    v = F.col("value")
    rows = events(spark, sf).select("user_id", model.alias("model"), F.floor(v * 10).alias("input_tokens"), F.floor(v).alias("output_tokens"), F.floor(v * 3).alias("cache_read"))
    return U.turn_cost(rows, ["user_id"])


@R.add(
    "repeat_calls",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS repeated FROM events",
)
def repeat_calls(spark, sf):
    out = U.repeat_calls(events(spark, sf), ["user_id"], name="event_type", args=U.canonical_args(F.col("props")), order=["ts", "event_id"])
    return out.select("event_id", "user_id", "repeated")


@R.add("session_tail", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS position FROM conversations QUALIFY position <= 8")
def session_tail(spark, sf):
    return U.session_tail(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "position")


@R.add(
    "daily_budget",
    "SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE AS day, row_number() OVER (PARTITION BY (ts + INTERVAL 9 HOUR)::DATE ORDER BY ts, event_id) <= 300 AS accepted FROM events",
)
def daily_budget(spark, sf):
    return U.daily_budget(events(spark, sf), V.kst_day(F.col("ts")), order=["ts", "event_id"], budget=300).select("event_id", "day", "accepted")


@R.add(
    "daily_budget_units",
    """WITH RECURSIVE c AS (SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE AS day, 1 + event_id % 7 AS units, row_number() OVER (PARTITION BY (ts + INTERVAL 9 HOUR)::DATE ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT event_id, day, i, units <= 500 AS accepted, CASE WHEN units <= 500 THEN units ELSE 0 END AS used FROM c WHERE i = 1
      UNION ALL SELECT c.event_id, c.day, c.i, w.used + units <= 500, CASE WHEN w.used + units <= 500 THEN w.used + units ELSE w.used END FROM w JOIN c ON c.day = w.day AND c.i = w.i + 1)
    SELECT event_id, day, accepted FROM w""",
)
def daily_budget_units(spark, sf):
    calls = events(spark, sf).withColumn("units", 1 + F.col("event_id") % 7)
    return U.daily_budget(calls, V.kst_day(F.col("ts")), order=["ts", "event_id"], units="units", budget=500).select("event_id", "day", "accepted")


@R.add(
    "lockout",
    """WITH RECURSIVE c AS (SELECT user_id, event_id, event_id // 40 AS sec, event_type NOT IN ('error', 'click', 'view') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    w AS (SELECT user_id, event_id, i, CASE WHEN ok THEN 'accepted' ELSE 'failed' END AS outcome, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0::BIGINT AS until FROM c WHERE i = 1
      UNION ALL SELECT c.user_id, c.event_id, c.i, CASE WHEN until - sec >= 1 THEN 'locked' WHEN ok THEN 'accepted' WHEN fails >= 4 THEN 'locking' ELSE 'failed' END,
        CASE WHEN until - sec >= 1 THEN fails WHEN ok OR fails >= 4 THEN 0 ELSE fails + 1 END, CASE WHEN until - sec >= 1 THEN until WHEN NOT ok AND fails >= 4 THEN sec + 300 ELSE 0 END
      FROM w JOIN c ON c.user_id = w.user_id AND c.i = w.i + 1)
    SELECT user_id, event_id, outcome FROM w""",
)
def lockout(spark, sf):
    """Most kinds of events are failed attempts; time runs fast, so that locks happen."""
    rows = events(spark, sf).select(
        "user_id", "event_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id div 40)").alias("ts"),
        (~F.col("event_type").isin("error", "click", "view")).alias("ok"),
    )
    return U.attempt_lockout(rows)


@R.add(
    "ttl_fetches",
    """WITH RECURSIVE c AS (SELECT user_id::VARCHAR AS key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT key, event_id, i, us AS fetched, 'live' AS state FROM c WHERE i = 1
      UNION ALL SELECT c.key, c.event_id, c.i, CASE WHEN us - fetched >= 21600000000 THEN us ELSE fetched END, CASE WHEN us - fetched >= 21600000000 THEN 'live' ELSE 'cached' END
      FROM w JOIN c ON c.key = w.key AND c.i = w.i + 1)
    SELECT key, event_id, state FROM w""",
)
def ttl_fetches(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    return U.ttl_fetches(rows, ttl=6 * 3600)


@R.add("active_documents", "SELECT o_orderkey, o_orderpriority AS index_version FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def active_documents(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", F.col("o_orderpriority").alias("index_version"), (F.col("o_orderstatus") == "O").alias("active"))
    return M.active_documents(rows, index_version="2-HIGH").drop("active")


SCORED_SQL = f"""{VIDEO_SQL}, scored AS (SELECT game_id, id, (2 + (published_at >= game_date AND published_at <= game_date + 2)::INT + (contains(title, concat(m, '.', dd)) OR contains(title, concat(lpad(m::VARCHAR, 2, '0'), '.', lpad(dd::VARCHAR, 2, '0')))
        OR contains(title, concat(m, '월 ', dd, '일')))::INT + 1)::INT AS score FROM pairs WHERE title <> 'preview')
"""


def highlight_inputs(spark, sf):
    """Orders as games of two channels; the second one does not exist."""
    games_of, uploads = videos_of_games(spark, sf)
    g = games_of.select(
        F.col("game_id").cast("string").alias("game_id"), "game_date", F.col("code").alias("home_code"), F.lit("NX").alias("away_code"), F.lit("game").alias("home_name"), F.lit("highlight").alias("away_name"),
    )
    ups = uploads.withColumn("id", F.col("id").cast("string"))
    dim = table(spark, sf, "region").select(
        F.col("r_name").alias("full"), F.col("r_name").alias("short"), F.array(F.concat(F.lit("x"), "r_name")).alias("aliases")
    )
    channels = table(spark, sf, "customer").select(F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("code"))
    return g, channels, ups, dim


@R.add(
    "find_highlights",
    f"""WITH {SCORED_SQL}, passed AS (SELECT * FROM scored WHERE score >= 3),
    web AS (SELECT g.game_id, v.id, v.title, v.id % 5 = 0 AS named, coalesce(published_at >= game_date AND published_at <= game_date + 2, false) AS win,
        contains(title, concat(m, '.', dd)) OR contains(title, concat(lpad(m::VARCHAR, 2, '0'), '.', lpad(dd::VARCHAR, 2, '0'))) OR contains(title, concat(m, '월 ', dd, '일')) AS tok
      FROM d AS g LEFT JOIN v ON v.id = g.game_id
      WHERE g.game_id % 3 > 0 AND g.code IN (SELECT concat('N', c_custkey) FROM customer) AND g.game_id NOT IN (SELECT game_id FROM passed WHERE game_id IS NOT NULL)),
    verified AS (SELECT game_id, id, score FROM passed UNION ALL
      SELECT game_id, id, max(CASE WHEN title <> 'preview' AND named AND (tok OR win) THEN 3 + tok::INT + win::INT ELSE 0 END) AS score FROM web WHERE id IS NOT NULL GROUP BY game_id, id),
    best AS (SELECT game_id, id::VARCHAR AS id, score, row_number() OVER (PARTITION BY game_id ORDER BY score DESC, id::VARCHAR)::INT AS place FROM verified WHERE score >= 3 QUALIFY place <= 4)
    SELECT o_orderkey::VARCHAR AS game_id, CASE WHEN best.game_id IS NOT NULL THEN 'ok' WHEN o_orderkey IN (SELECT game_id FROM verified) THEN 'score_below_min' WHEN o_orderkey IN (SELECT game_id FROM web) THEN 'verify_failed'
        WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'no_candidate' ELSE 'no_channel' END AS stage, id, place, score::INT AS score
    FROM orders LEFT JOIN best ON best.game_id = o_orderkey""",
)
def find_highlights(spark, sf):
    """The videos picked for every game, best first, and its stage.

    Where no channel has one, the web names the video of the game's own number for two games in three; the titles of
    one video in five name both teams when they are looked up.
    """
    g, channels, ups, dim = highlight_inputs(spark, sf)
    looked_up = F.when(F.col("id").cast("long") % 5 == 0, F.concat("title", F.lit(" game highlight"))).otherwise(F.col("title"))
    details = ups.select("id", looked_up.alias("title"), "published_at", F.lit("1:00").alias("duration"), F.lit(True).alias("embeddable"), F.lit("t").alias("thumbnail_url"), F.lit("u").alias("url"))
    web = g.where(F.col("game_id").cast("long") % 3 > 0).select("game_id", F.col("game_id").alias("id"))
    picked, stages = P.find_highlights(g, channels, ups, details, dim, fallback=web)
    return stages.join(picked.select("game_id", "id", "place", "score"), "game_id", "left")


@R.add(
    "channel_trace",
    f"""WITH {SCORED_SQL}, found AS (SELECT game_id, count(*) FILTER (score >= 3) AS passed, max(score) AS top FROM scored GROUP BY game_id),
    listed AS (SELECT user_id, count(*) AS received FROM events GROUP BY user_id)
    SELECT o_orderkey::VARCHAR AS game_id, 0 AS priority, concat('N', o_custkey) AS code, CASE WHEN received IS NULL THEN 'playlist_empty' ELSE 'channel' END AS stage,
      coalesce(received, 0) AS received, coalesce(passed, 0) AS passed, coalesce(top, 0) AS top
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN listed ON user_id = o_custkey LEFT JOIN found ON game_id = o_orderkey""",
)
def channel_trace(spark, sf):
    """What the channel of every game gave."""
    g, channels, ups, dim = highlight_inputs(spark, sf)
    return P.channel_trace(g, channels, ups, dim)


@R.add("kst_day", "SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE AS day, (ts + INTERVAL 9 HOUR)::DATE AS day_of_text FROM events")
def kst_day(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events(spark, sf).select("event_id", V.kst_day(F.col("ts")).alias("day"), V.kst_date(text).alias("day_of_text"))


@R.add(
    "value_formats",
    r"""SELECT event_id, (event_id % 200 + (event_id % 3) / 3.0)::DOUBLE AS innings, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id * 13 % 90000 END AS seconds,
      CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id * 13 % 90000 >= 3600 THEN printf('%d:%02d:%02d', event_id * 13 % 90000 // 3600, event_id * 13 % 90000 % 3600 // 60, event_id * 13 % 90000 % 60)
        ELSE printf('%d:%02d', event_id * 13 % 90000 // 60, event_id * 13 % 90000 % 60) END AS duration,
      ts::DATE AS day8, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE '2026-09-15' END AS as_of,
      CASE event_id % 4 WHEN 0 THEN '실시간' WHEN 1 THEN '저장본(최신)' WHEN 2 THEN concat('오래된 저장본(최신 조회 실패, ', ts::DATE, ' 기준)') ELSE '기본정보' END AS status,
      (CASE WHEN regexp_matches(props, '"k": [0-9]+') THEN regexp_extract(props, '"k": ([0-9]+)', 1) END)::INT AS k FROM events""".replace("(event_id % 3) / 3.0)::DOUBLE", "round((event_id % 3) / 3.0, 3))::DOUBLE"),
)
def value_formats(spark, sf):
    e, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    innings = F.concat((e % 200).cast("string"), F.when(e % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), (e % 3).cast("string"), F.lit("/3"))))
    n = e * 13 % 90000
    iso = F.when(e % 5 == 0, F.lit("P")).otherwise(
        F.format_string("P%dDT%dH%dM%dS", F.floor(n / 86400), F.floor(n % 86400 / 3600), F.floor(n % 3600 / 60), n % 60)
    )
    seconds = V.parse_duration(iso)
    raw = F.when(e % 3 == 0, F.concat(day, F.lit("T01:00:00Z"))).when(e % 3 == 1, F.concat(F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.lit(""))
    fresh = F.element_at(F.array(*[F.lit(s) for s in ("live", "cached", "stale", "static")]), (e % 4 + 1).cast("int"))
    return events(spark, sf).select(
        "event_id", V.parse_innings(innings).alias("innings"), seconds.alias("seconds"), V.format_duration(seconds).alias("duration"),
        V.date8(F.date_format("ts", "yyyyMMdd")).alias("day8"), V.published_as_of(raw, F.lit("2026-09-15").cast("date")).alias("as_of"),
        V.freshness_text(fresh, day).alias("status"), json_path(F.col("props"), "$.k").try_cast("int").alias("k"),
    )


@R.add("relevance_floor", "SELECT event_id, value FROM events WHERE value / 500 >= 0.5")
def relevance_floor(spark, sf):
    return P.keep_relevant(events(spark, sf).withColumn("score", F.col("value") / 500)).select("event_id", "value")


# ---------------------------------------------------------------- evaluation

CASE_SQL = """
cases AS (SELECT l.doc_id, quality, toxic, lang, source, n_chars, lang AS grp FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
checks AS (SELECT *, quality = 1 AS route_ok, CASE WHEN doc_id % 4 = 0 THEN starts_with(source, 'src1') END AS top1_ok, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN toxic = 0 AND quality = 1 ELSE toxic = 0 END END AS status_ok,
  CASE WHEN doc_id % 5 = 0 THEN contains(source, '1') AND regexp_matches(source, 'src[0-9]+') END AS must_ok, CASE WHEN doc_id % 6 = 0 THEN source = 'src7' END AS exact_ok,
  CASE WHEN doc_id % 7 <> 0 THEN lang = 'en' END AS kind_ok, doc_id % 2 = 0 AS scored, CASE WHEN doc_id % 2 = 0 THEN (CASE WHEN starts_with(source, 'src1') THEN 0.5 ELSE 0 END + CASE WHEN starts_with(source, 'src') THEN 0.5 ELSE 0 END) ELSE 1.0 END AS recall,
  CASE WHEN toxic = 0 THEN 'answered' ELSE 'out' END AS status FROM cases),
summary AS (SELECT grp, count(*) AS cases, count(*) FILTER (route_ok) AS route_match, round(coalesce(sum(recall) FILTER (scored), 0) / greatest(count(*) FILTER (scored), 1), 3)::DOUBLE AS recall_at_6, count(*) FILTER (scored) AS recall_scored_cases,
  coalesce(bool_and(top1_ok), true) AS top1_ok, count(*) FILTER (status_ok) AS status_match, count(status_ok) AS status_total, count(*) FILTER (must_ok) AS must_contain_match, count(must_ok) AS must_contain_total,
  count(*) FILTER (exact_ok) AS refusal_exact, count(exact_ok) AS refusal_exact_total, round(count(*) FILTER (status = 'answered' AND n_chars % 3 > 0) / greatest(count(*) FILTER (status = 'answered'), 1), 3)::DOUBLE AS sources_nonempty_ratio,
  count(*) FILTER (kind_ok) AS answer_kind_match, count(kind_ok) AS answer_kind_total, count(*) FILTER (doc_id % 50 = 3) AS schema_fallback, count(*) FILTER (doc_id % 90 = 5) AS blocking_lint FROM checks GROUP BY grp)
"""


def golden(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as evaluated cases."""
    d = F.col("doc_id")
    empty = F.array().cast("array<string>")
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    rows = joined.select(
        d.alias("qid"), F.col("lang").alias("grp"), F.when(F.col("quality") == 1, F.lit("rule")).otherwise(F.lit("latest")).alias("route"), F.lit("rule").alias("expect_route"),
        F.when(d % 4 == 0, F.lit("src1")).alias("expect_top1"), F.array("source").alias("retrieved"),
        F.when(d % 3 == 0, F.lit("answered")).alias("expect_status"), empty.alias("expect_status_in"), F.when(F.col("toxic") == 0, F.lit("answered")).otherwise(F.lit("out")).alias("status"),
        F.when((d % 3 == 0) & (d % 2 == 0), F.array(F.lit("live"))).otherwise(empty).alias("expect_freshness_in"), F.when(F.col("quality") == 1, F.lit("live")).otherwise(F.lit("static")).alias("freshness"),
        F.when(d % 5 == 0, F.array(F.lit("1"), F.lit("src[0-9]+"))).otherwise(empty).alias("must_contain"), F.col("source").alias("answer"),
        F.when(d % 6 == 0, F.lit("src7")).alias("expect_answer_exact"), F.lit("en").alias("expect_answer_kind"), (d % 7 != 0).alias("called"), F.col("lang").alias("answer_kind"),
        (F.col("n_chars") % 3).alias("sources"),
        F.array_compact(F.array(F.when(d % 50 == 3, F.lit("SCHEMA_FALLBACK")), F.when(d % 90 == 5, F.lit("EMPTY_HEADLINE")))).alias("lint_codes"),
    )
    expected = rows.select("qid", F.when(F.col("qid") % 2 == 0, F.array(F.lit("src1"), F.lit("src"))).otherwise(empty).alias("expected"))
    recalled = E.recall_at_k(expected, rows.select("qid", "retrieved")).select("qid", "scored", "recall")
    return E.case_checks(rows).join(recalled, "qid")


@R.add("eval_summary", f"WITH {CASE_SQL} SELECT * FROM summary")
def eval_summary(spark, sf):
    return E.eval_summary(golden(spark, sf), ["grp"])


@R.add(
    "gates",
    f"""WITH {CASE_SQL} SELECT grp, array_to_string(list_filter([CASE WHEN recall_at_6 < 0.8 THEN 'recall_at_6' END, CASE WHEN cases - route_match > 0 THEN 'route' END, CASE WHEN NOT top1_ok THEN 'top1' END,
      CASE WHEN status_total - status_match > 2 THEN 'status' END, CASE WHEN refusal_exact < refusal_exact_total THEN 'refusal_exact' END, CASE WHEN sources_nonempty_ratio < 1 THEN 'sources_nonempty' END,
      CASE WHEN must_contain_match < must_contain_total THEN 'must_contain' END, CASE WHEN schema_fallback > 0 THEN 'schema_fallback' END, CASE WHEN blocking_lint > 0 THEN 'lint_blocking' END,
      CASE WHEN answer_kind_total - answer_kind_match > 1 THEN 'answer_kind' END], lambda x: x IS NOT NULL), ',') AS failures, failures = '' AS passed FROM summary""",
)
def gates(spark, sf):
    return E.check_gates(E.eval_summary(golden(spark, sf), ["grp"])).select("grp", F.array_join("failures", ",").alias("failures"), "passed")


@R.add(
    "verdict_averages",
    """WITH v AS (SELECT p_brand, CASE WHEN p_size % 9 = 0 THEN NULL ELSE greatest(1, least(5, p_size % 8)) END AS g, greatest(1, least(5, p_partkey % 7))::INT AS s FROM part)
    SELECT p_brand, count(*) FILTER (g IS NOT NULL) AS judge_scored, count(*) FILTER (g IS NULL) AS judge_failed, round(avg(g), 2) AS judge_grounded_avg, min(g) AS judge_grounded_min,
      round(avg(s) FILTER (g IS NOT NULL), 2) AS judge_schema_format_avg, min(s) FILTER (g IS NOT NULL) AS judge_schema_format_min FROM v GROUP BY p_brand""",
)
def verdict_averages(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_brand", F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 8).alias("grounded"), (F.col("p_partkey") % 7).alias("schema_format")
    )
    return E.verdict_averages(rows, ("grounded", "schema_format"), ["p_brand"])
