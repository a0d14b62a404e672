"""Scalar columns for dates, durations, links, innings, scores and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offsets, thresholds, formats and label texts.
KST_SECONDS = 9 * 3600
INNINGS = r"^\s*(?:(\d+)\s*)?(?:(\d)\s*/\s*(\d))?\s*$"
DURATION = r"^P(?:(\d+)D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
CHANNEL_ID = r"^UC[A-Za-z0-9_-]{22}$"
UPLOADS_ID = r"^UU[A-Za-z0-9_-]{22}$"
LIKELY_SCORE = 0.7
ABSTAIN_DENSE = 0.30
ABSTAIN_BM25_RATIO = 0.15
FRESHNESS_TEXT = {"live": "실시간", "cached": "저장본(최신)", "static": "기본정보"}
DEFAULT_FRESHNESS_TEXT = "기본정보"
STALE_TEXT = "오래된 저장본(최신 조회 실패, {as_of} 기준)"
UNKNOWN_STADIUM = "구장 미정"


def _number(parts: Column, place: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(place)).try_cast("bigint"), F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_innings(raw: Column) -> Column:
    def total(parts: Column) -> Column:
        whole, num, den = (_number(parts, i).cast("double") for i in range(3))
        return F.round(whole + F.coalesce(F.try_divide(num, den), F.lit(0.0)), 3)

    return F.when(raw.rlike(INNINGS) & (raw != ""), _once(F.split(F.regexp_replace(raw, INNINGS, "$1:$2:$3"), ":"), total))


def parse_duration(iso: Column) -> Column:
    def seconds(parts: Column) -> Column:
        d, h, m, s = (_number(parts, i) for i in range(4))
        return d * 86400 + h * 3600 + m * 60 + s

    return F.when(iso.rlike(DURATION), _once(F.split(F.regexp_replace(iso, DURATION, "$1:$2:$3:$4"), ":"), seconds))


def format_duration(seconds: Column) -> Column:
    def shown(seconds: Column) -> Column:
        hours = F.floor(seconds / 3600).cast("int")
        minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int")
        rest = F.pmod(seconds, F.lit(60)).cast("int")
        return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).when(
            seconds.isNotNull(), F.format_string("%d:%02d", minutes, rest)
        )

    return _once(seconds, shown)


def kst_day(moment: Column) -> Column:
    """Korean calendar day of a UTC wall-clock timestamp."""
    return F.to_date(moment + F.expr(f"interval {KST_SECONDS} seconds"))


def kst_date(rfc3339: Column) -> Column:
    """Korean calendar day of an RFC 3339 text; a missing offset means UTC."""
    raw = F.trim(rfc3339)
    zoned = F.when(raw.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$") & raw.rlike(r"\d{2}:\d{2}"), raw).otherwise(
        F.concat(raw, F.when(F.length(raw) == 10, F.lit("T00:00:00Z")).otherwise(F.lit("Z")))
    )
    day = F.floor((F.unix_seconds(zoned.try_cast("timestamp")) + KST_SECONDS) / 86400).cast("int")
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.date_add(F.to_date(F.lit("1970-01-01")), day))


def published_as_of(raw: Column, today: Column) -> Column:
    """ISO prefix, else the day of an RFC 822 date, else today, as text."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    iso = (F.length(text) >= 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    day = F.regexp_extract(text, r"(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})", 1)
    mail = F.try_to_timestamp(F.regexp_replace(day, r"\s+", " "), F.lit("d MMM yyyy"))
    return F.when(iso, F.substring(text, 1, 10)).otherwise(
        F.coalesce(F.date_format(mail, "yyyy-MM-dd"), today.cast("string"))
    )


def url_host(url: Column) -> Column:
    """Lower-case host without a leading `www.` and then `m.`."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", ""), F.lit(""))


def video_id(url: Column) -> Column:
    host = url_host(url)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    first = F.regexp_extract(path, r"^/+([^/]*)", 1)
    embedded = F.regexp_extract(path, r"^/+(?:shorts|embed|live|v)/+([^/]+)", 1)
    watch = F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)
    found = F.when(host == "youtu.be", first).when(
        host.isin("youtube.com", "music.youtube.com"), F.when(path == "/watch", watch).otherwise(embedded)
    )
    return F.when(found.rlike(VIDEO_ID), found)


def uploads_playlist_id(channel: Column) -> Column:
    cid = F.trim(channel)
    return F.when(cid.rlike(CHANNEL_ID), F.concat(F.lit("UU"), F.substring(cid, 3, 22)))


def date_tokens(day: Column) -> Column:
    """The six spellings of a day seen in video titles."""
    m, d = F.month(day), F.dayofmonth(day)
    shapes = ("%d.%d", "%02d.%02d", "%d/%d", "%02d/%02d", "%d월 %d일", "%d월%d일")
    return F.array(*[F.format_string(s, m, d) for s in shapes])


def date8(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")).otherwise(
        text.try_cast("date")
    )


def confidence(score: Column) -> Column:
    return F.when(score >= LIKELY_SCORE, F.lit("likely")).otherwise(F.lit("uncertain"))


def card_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 10)


def short_day(day: Column) -> Column:
    """Month and day in words, so that it never reads as a rule number."""
    return F.format_string("%d월 %d일", F.month(day), F.dayofmonth(day))


def highlight_query(day: Column, home: Column, away: Column) -> Column:
    return F.concat_ws(" ", away, home, short_day(day), F.lit("야구 하이라이트"))


def place_query(stadium_short: Column) -> Column:
    return F.concat(stadium_short, F.lit("야구장 근처 맛집 추천"))


def map_query(stadium: Column) -> Column:
    return F.concat(stadium, F.lit(" 근처 맛집"))


def game_key(day: Column, away: Column, home: Column) -> Column:
    def shown(code: Column) -> Column:
        return F.coalesce(F.nullif(code, F.lit("")), F.lit("?"))

    return F.concat_ws(":", F.lit("yt:hl"), F.date_format(day, "yyyy-MM-dd"), shown(away), shown(home))


def game_line(
    relation: Column,
    start: Column,
    away: Column,
    home: Column,
    stadium: Column,
    status: Column,
    away_score: Column,
    home_score: Column,
) -> Column:
    when = short_day(start)
    place = F.concat(F.lit(" ("), F.coalesce(F.nullif(stadium, F.lit("")), F.lit(UNKNOWN_STADIUM)), F.lit(")"))
    versus = F.concat(away, F.lit(" 대 "), home)
    score = F.when(status == "RESULT", F.format_string(" %d-%d", away_score, home_score)).otherwise(F.lit(""))
    ahead = F.concat(when, F.date_format(start, " HH:mm "), versus, place)
    past = F.concat(when, F.lit(" "), versus, score, place)
    return F.when(relation == "upcoming", ahead).otherwise(past)


def freshness_text(freshness: Column, as_of: Column) -> Column:
    out = F.lit(DEFAULT_FRESHNESS_TEXT)
    for name, label in FRESHNESS_TEXT.items():
        out = F.when(freshness == name, F.lit(label)).otherwise(out)
    before, after = STALE_TEXT.split("{as_of}")
    return F.when(freshness == "stale", F.concat(F.lit(before), as_of, F.lit(after))).otherwise(out)


def should_abstain(
    has_exact: Column,
    dense_failed: Column,
    dense_top: Column,
    bm25_ratio: Column,
    *,
    dense_threshold: float = ABSTAIN_DENSE,
    ratio_threshold: float = ABSTAIN_BM25_RATIO,
    on_dense_failure: bool = False,
) -> Column:
    weak = F.when(dense_failed, F.lit(on_dense_failure)).otherwise(dense_top < dense_threshold)
    return ~has_exact & weak & (bm25_ratio < ratio_threshold)
