"""Games matched to videos by date, scored, and picked channel by channel; place cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import values as V
from corvane.operators.answers import dedupe_sources
from corvane.operators.ranking import first_nonempty, top_n_per_group
from corvane.session import stored_table

# Score limits, windows, caps, stages and notice texts.
LEAGUE_CODE = "KBO"
MIN_SCORE = 3
PUBLISH_WINDOW_DAYS = 2
# Days after a game in which an upload that names its day can be of that game; only newest uploads are ever listed.
TOLD_DAYS = 30
MAX_VERIFIED = 50
MAX_KEPT = 4
STAGES = ("disabled", "no_channel", "playlist_empty", "no_candidate", "verify_failed", "score_below_min", "ok")
PLACE_MIN_SCORE = 0.6
PLACE_MAX = 4
PLACE_SNIPPET = 220
WEB_MIN_SCORE = 0.5
WEB_MAX = 5
WEB_SNIPPET = 600
NOTICE_LABEL = "맛집 정보 안내"
NOTICE_TEXT = (
    "아래 맛집 정보는 웹 검색 결과이며 영업 여부·위치·메뉴가 확인되지 않았습니다. "
    "각 항목의 출처 링크에서 직접 확인해야 합니다. "
    "상호는 검색 결과 제목에 적힌 그대로만 옮기고, 적혀 있지 않은 상호·주소·전화번호·"
    "영업시간·평점을 만들어 쓰지 마세요."
)


def channel_order(games: DataFrame, channels: DataFrame, league: str = LEAGUE_CODE) -> DataFrame:
    """(game_id, priority, code): home, away, league channel in that order, each once, only existing ones."""
    codes = F.filter(F.array_distinct(F.array("home_code", "away_code", F.lit(league))), lambda c: c.isNotNull())
    ordered = games.select("game_id", F.posexplode(codes).alias("priority", "code"))
    return ordered.join(channels.select("code").distinct(), "code")


def team_variants(teams: DataFrame) -> DataFrame:
    """(name, variants): for every name a team goes by, all its names, longest first."""
    names = F.array_distinct(F.filter(F.concat(F.array("full"), "aliases", F.array("short")), lambda n: F.coalesce(n, F.lit("")) != ""))
    sized = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    called = F.array_distinct(F.concat(F.array("full"), "aliases"))
    listed = teams.select(called.alias("_called"), sized.alias("_sized"))
    return listed.select(F.explode("_called").alias("name"), F.transform("_sized", lambda s: s["n"]).alias("variants"))


def date_mentions(title: Column, *, exact: bool = False) -> Column:
    """Month-day keys (`m-d`) whose usual spelling is contained in the title.

    A short spelling also sits inside a longer one ("9.1" in "9.13"); `exact` keeps only whole numbers.
    """
    left = F.regexp_extract_all(title, F.lit(r"(\d{1,2})([./])(?=(\d{1,2}))"), F.lit(1))
    right = F.regexp_extract_all(title, F.lit(r"(\d{1,2})([./])(?=(\d{1,2}))"), F.lit(3))
    words_m = F.regexp_extract_all(title, F.lit(r"(\d{1,2})월 ?(\d{1,2})일"), F.lit(1))
    words_d = F.regexp_extract_all(title, F.lit(r"(\d{1,2})월 ?(\d{1,2})일"), F.lit(2))

    def key(m: Column, d: Column) -> Column:
        return F.concat_ws("-", m.cast("int").cast("string"), d.cast("int").cast("string"))

    def plain(n: Column) -> Column:
        return ~n.startswith("0")

    def numeric(p: Column) -> Column:
        m, d = p["m"], p["d"]
        m1, d1 = F.right(m, F.lit(1)), F.left(d, F.lit(1))
        both2 = (F.length(m) == 2) & (F.length(d) == 2)
        whole = F.when(both2 | (plain(m) & plain(d)), key(m, d))
        if exact:
            return F.array(whole)
        return F.array(
            whole,
            F.when(plain(m1) & plain(d), key(m1, d)),
            F.when(plain(m) & plain(d1), key(m, d1)),
            F.when(plain(m1) & plain(d1), key(m1, d1)),
        )

    def worded(p: Column) -> Column:
        m, d = p["m"], p["d"]
        m1 = F.right(m, F.lit(1))
        return F.array(F.when(plain(m) & plain(d), key(m, d)), F.when(plain(m1) & plain(d), key(m1, d)))

    spelled = F.concat(
        F.flatten(F.transform(F.arrays_zip(left.alias("m"), right.alias("d")), numeric)),
        F.flatten(F.transform(F.arrays_zip(words_m.alias("m"), words_d.alias("d")), worded)),
    )
    return F.array_distinct(F.array_compact(spelled))


def match_videos(
    games: DataFrame, videos: DataFrame, *, window: int = PUBLISH_WINDOW_DAYS, told_days: int = TOLD_DAYS, exact: bool = False
) -> DataFrame:
    """(game_id, priority, code, id, …): videos of a game's channels near it in time or naming its day.

    A video that names the day counts if it came out on the day or within `told_days` after it, or if it is not known
    when; so a title of an earlier season never meets this one's game.

    games: game_id, code, priority, game_date. videos: code, id, title, published_at. Both ways are
    equi-joins, on (code, day) and on (code, month-day); only pairs that agree on a date ever meet.
    """
    days = games.withColumn("_day", F.explode(F.sequence(F.col("game_date"), F.date_add("game_date", window))))
    shown = videos.withColumn("_day", F.col("published_at"))
    near = days.join(shown, ["code", "_day"]).drop("_day")
    named = videos.withColumn("_md", F.explode(date_mentions(F.col("title"), exact=exact)))
    md = F.concat_ws("-", F.month("game_date").cast("string"), F.dayofmonth("game_date").cast("string"))
    told = games.withColumn("_md", md).join(named, ["code", "_md"])
    late = F.col("published_at").between(F.date_add("game_date", window + 1), F.date_add("game_date", told_days))
    return near.unionByName(told.where(F.coalesce(late, F.lit(True))).drop("_md"))


def video_score(
    title: Column,
    published: Column,
    game_date: Column,
    home_hit: Column,
    away_hit: Column,
    trusted: Column,
    require_both: Column,
    *,
    keyword: L.Pattern = L.HIGHLIGHT,
    excluded: L.Pattern = L.EXCLUDED_VIDEO,
) -> Column:
    """Points for keyword, date in the title, upload window and team names; 0 rules the video out."""
    has_keyword = L.hit(title, keyword)
    has_token = F.exists(V.date_tokens(game_date), lambda t: F.contains(title, t))
    in_window = F.coalesce(published.between(game_date, F.date_add(game_date, PUBLISH_WINDOW_DAYS)), F.lit(False))
    both, one = home_hit & away_hit, home_hit | away_hit
    out = (
        L.hit(title, excluded)
        | ~(has_token | in_window)
        | ~(has_token | has_keyword)
        | (require_both & ~both)
        | (~trusted & (~has_keyword | ~one))
    )
    points = (
        trusted.cast("int") + has_keyword.cast("int") + has_token.cast("int") + in_window.cast("int")
        + F.when(both, 2).when(one, 1).otherwise(0)
    )
    return F.when(out, F.lit(0)).otherwise(points)


def unescape(title: Column) -> Column:
    """The named HTML entities that occur in titles."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(sign))
    return title


def score_videos(pairs: DataFrame, variants: DataFrame, *, trusted: bool = True, require_both: Column | None = None) -> DataFrame:
    """Adds `score` to game-video pairs carrying home_name, away_name, title, published_at, game_date."""
    v = variants
    named = pairs.join(v.select(F.col("name").alias("home_name"), F.col("variants").alias("_home")), "home_name", "left").join(
        v.select(F.col("name").alias("away_name"), F.col("variants").alias("_away")), "away_name", "left"
    )
    title = unescape(F.col("title"))

    def known(found: str, own: str) -> Column:
        return F.coalesce(F.col(found), F.filter(F.array(own), lambda n: F.coalesce(n, F.lit("")) != ""))

    def any_name(found: str, own: str) -> Column:
        return F.exists(known(found, own), lambda n: F.contains(title, n))

    both = require_both if require_both is not None else F.col("code") == LEAGUE_CODE
    score = video_score(
        title, F.col("published_at"), F.col("game_date"), any_name("_home", "home_name"), any_name("_away", "away_name"),
        F.lit(trusted), both,
    )
    return named.withColumn("score", score).drop("_home", "_away")


def channel_trace(games: DataFrame, channels: DataFrame, uploads: DataFrame, teams: DataFrame) -> DataFrame:
    """(game_id, priority, code, stage, received, passed, top): what each channel asked for a game gave, in order, up
    to the first one with a video that passes. A channel without any upload is `playlist_empty`, others `channel`."""
    asked = games.join(channel_order(games, channels), "game_id")
    scored = score_videos(match_videos(asked, uploads), team_variants(teams)).dropDuplicates(["game_id", "code", "id"])
    found = scored.groupBy("game_id", "code").agg(F.count_if(F.col("score") >= MIN_SCORE).alias("passed"), F.max("score").alias("top"))
    listed = uploads.groupBy("code").agg(F.count(F.lit(1)).alias("received"))
    rows = asked.select("game_id", "priority", "code").join(listed, "code", "left").join(found, ["game_id", "code"], "left")
    rows = rows.fillna(0, ["received", "passed", "top"])
    before = Window.partitionBy("game_id").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_done", F.coalesce(F.max("passed").over(before), F.lit(0)) > 0).where(~F.col("_done"))
    stage = F.when(F.col("received") == 0, F.lit("playlist_empty")).otherwise(F.lit("channel"))
    return rows.select("game_id", "priority", "code", stage.alias("stage"), "received", "passed", "top")


def find_highlights(
    games: DataFrame,
    channels: DataFrame,
    uploads: DataFrame,
    details: DataFrame,
    teams: DataFrame,
    *,
    fallback: DataFrame | None = None,
    enabled: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(picked videos, one stage row per game).

    games: game_id, game_date, home_code, away_code, home_name, away_name. uploads: code, id, title,
    published_at. details: verified videos. fallback: game_id, id of web-found videos, scored after
    verification against both team names; they count for games whose channels gave none, not for games without one.
    """
    if not enabled:
        stage = games.select("game_id", F.lit("disabled").alias("stage"))
        return details.limit(0).withColumn("game_id", F.lit(None).cast("string")), stage
    variants = team_variants(teams)
    # A team outside the table still goes by its own name.
    order = channel_order(games, channels)
    asked = games.join(order, "game_id")
    scored = score_videos(match_videos(asked, uploads), variants)
    first = first_nonempty(scored, ["game_id"], "priority", F.col("score") >= MIN_SCORE)
    best = top_n_per_group(first.dropDuplicates(["game_id", "id"]), ["game_id"], [F.desc("score"), F.col("id")], MAX_VERIFIED, rank=None)
    # At most MAX_VERIFIED short rows for a game, read for the picks and for each stage.
    kept_ids = stored_table(best.select("game_id", "id", "score"), "kept")
    info = details.select("id", "title", "published_at", "duration", "embeddable", "thumbnail_url", "url")
    verified = kept_ids.select("game_id", "id", "score").join(info, "id")
    if fallback is not None:
        missing = fallback.dropDuplicates(["game_id", "id"]).join(kept_ids.select("game_id").distinct(), "game_id", "left_anti")
        missing = missing.join(order.select("game_id").distinct(), "game_id", "left_semi")
        pairs = missing.join(info, "id").join(games, "game_id")
        again = score_videos(pairs, variants, trusted=False, require_both=F.lit(True))
        again = top_n_per_group(again, ["game_id", "id"], [F.desc("score"), F.col("title"), F.col("published_at")], 1, rank=None)
        verified = verified.unionByName(again.select("game_id", "id", "score", *[c for c in info.columns if c != "id"]))
        candidates = kept_ids.select("game_id").unionByName(missing.select("game_id")).distinct()
    else:
        candidates = kept_ids.select("game_id").distinct()
    picked = top_n_per_group(
        verified.where(F.col("score") >= MIN_SCORE), ["game_id"], [F.desc("score"), F.col("id")], MAX_KEPT, rank="place"
    )

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("game_id", F.lit(True).alias(name)).distinct()

    staged = (
        games.select("game_id")
        .join(mark(order, "_channel"), "game_id", "left")
        .join(mark(candidates, "_candidate"), "game_id", "left")
        .join(mark(verified, "_verified"), "game_id", "left")
        .join(mark(picked, "_picked"), "game_id", "left")
    )
    stage = (
        F.when(F.col("_picked"), F.lit("ok"))
        .when(F.col("_verified"), F.lit("score_below_min"))
        .when(F.col("_candidate"), F.lit("verify_failed"))
        .when(F.col("_channel"), F.lit("no_candidate"))
        .otherwise(F.lit("no_channel"))
    )
    return picked, staged.select("game_id", stage.alias("stage"))


def keep_relevant(results: DataFrame, min_score: float = WEB_MIN_SCORE) -> DataFrame:
    return results.where(F.coalesce("score", F.lit(0.0)) >= min_score)


def with_required_fields(results: DataFrame, *columns: str) -> DataFrame:
    kept = results
    for c in columns:
        kept = kept.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return kept


def web_attempts(results: DataFrame, *, key: str = "query", min_score: float = WEB_MIN_SCORE) -> DataFrame:
    """Results of the first attempt (restricted, open, general) that has a relevant one."""
    return first_nonempty(results, [key], "attempt", F.coalesce("score", F.lit(0.0)) >= min_score)


def web_entries(results: DataFrame, today: Column, *, key: str = "query", limit: int = WEB_MAX) -> DataFrame:
    """Entries of the first `limit` results that carry content; position is the place among the results."""
    first = top_n_per_group(results, [key], [F.col("position")], limit, rank=None)
    content = F.trim(F.coalesce("content", F.lit("")))
    return first.where(content != "").select(
        key,
        F.lit("web").alias("kind"),
        F.concat(F.lit("웹 검색: "), F.coalesce("title", F.lit("제목 없음"))).alias("label"),
        F.substring(content, 1, WEB_SNIPPET).alias("text"),
        V.published_as_of(F.col("published_date"), today).alias("as_of"),
        F.col("url").alias("source_url"),
        V.confidence(F.col("score")).alias("confidence"),
        "position",
    )


def build_places(
    results: DataFrame, stadiums: DataFrame, today: Column, *, key: str = "query", limit: int = PLACE_MAX,
    min_score: float = PLACE_MIN_SCORE, with_map: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries with the notice first, cards, map rows). stadiums: key, stadium."""
    top = top_n_per_group(keep_relevant(results, min_score), [key], [F.col("position")], limit, rank=None)
    trimmed = top.withColumn("url", F.trim("url")).withColumn("title", F.trim("title"))
    usable = with_required_fields(trimmed, "url", "title").withColumn("label", F.col("title"))
    unique = dedupe_sources(usable, [key])
    snippet = F.substring(F.trim(F.coalesce("content", F.lit(""))), 1, PLACE_SNIPPET)
    level = V.confidence(F.coalesce("score", F.lit(0.0)))
    entries = unique.select(
        key, F.lit("place").alias("kind"), F.concat(F.lit("맛집 정보: "), "title").alias("label"), snippet.alias("text"),
        V.published_as_of(F.col("published_date"), today).alias("as_of"), F.col("url").alias("source_url"),
        level.alias("confidence"), "position",
    )
    cards = unique.select(
        key, V.card_id(F.col("url")).alias("id"), F.col("title").alias("name"), "url",
        F.nullif(snippet, F.lit("")).alias("snippet"), level.alias("confidence"), "position",
    )
    answered = unique.select(key).distinct()
    notice = answered.select(
        key, F.lit("place").alias("kind"), F.lit(NOTICE_LABEL).alias("label"), F.lit(NOTICE_TEXT).alias("text"),
        today.cast("string").alias("as_of"), F.lit(None).cast("string").alias("source_url"),
        F.lit("uncertain").alias("confidence"), F.lit(-1).alias("position"),
    )
    query = V.map_query(F.col("stadium"))
    maps = stadiums.join(answered, key, "left_semi").where(F.lit(with_map)).select(
        key, F.lit("map").alias("kind"), V.card_id(query).alias("id"), query.alias("title"), query.alias("map_query")
    )
    return notice.unionByName(entries), cards, maps
