"""Readers and writers of dimension, player, chunk, glossary and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEAM_SCHEMA = (
    "code string, full string, short string, aliases array<string>, hometown string, stadium string, "
    "stadium_short string, stadium_secondary_short string, source_url string"
)
CHANNEL_SCHEMA = "code string, title string, handle string, username string, channel_id string"
GLOSSARY_SCHEMA = "term_no int, term_en string, term_ko string, rule_id string, page int, aliases array<string>"
REGULATION_SCHEMA = (
    "id string, title string, keywords array<string>, text string, as_of date, source_url string, confidence string"
)
GOLDEN_SCHEMA = (
    "id int, question string, category string, expect_route string, expect_status string, "
    "expect_status_in array<string>, expect_freshness_in array<string>, expect_answer_kind string, "
    "expect_answer_exact string, expect_top1 string, expect_llm_called boolean, expected_rule_refs array<string>, "
    "must_contain array<string>"
)
STATS_SCHEMA = (
    "games int, avg double, hits int, hr int, rbi int, runs int, sb int, bb int, so int, obp double, slg double, "
    "ops double, era double, win int, lose int, save int, hold int, whip double, quality_starts int, "
    "innings string, innings_value double"
)
PLAYER_SCHEMA = (
    "_meta boolean, season int, captured_at date, player_count long, player_id string, name string, team_code string, "
    "player_type string, position string, back_number int, height_cm int, weight_kg int, is_qualified boolean, "
    f"is_retired boolean, league_rank int, stats struct<{STATS_SCHEMA.replace(' ', ':').replace(',:', ', ')}>"
)
DIMS = {
    "teams": (f"teams array<struct<{TEAM_SCHEMA}>>", "teams"),
    "channels": (f"channels array<struct<{CHANNEL_SCHEMA}>>", "channels"),
    "regulations": (f"items array<struct<{REGULATION_SCHEMA}>>", "items"),
    "golden": (f"cases array<struct<{GOLDEN_SCHEMA}>>", "cases"),
}


def load_dim(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A wrapped JSON list as rows with `ord`, its place in the file; kinds: teams, channels, regulations, golden, glossary."""
    if kind == "glossary":
        return spark.read.schema(GLOSSARY_SCHEMA).json(path, multiLine=True).withColumn("ord", F.col("term_no"))
    schema, field = DIMS[kind]
    wrapped = spark.read.schema(_nested(schema)).json(path, multiLine=True)
    return wrapped.select(F.posexplode(field).alias("ord", "_r")).select("ord", "_r.*")


def _nested(schema: str) -> str:
    """`name type` pairs inside struct<> need colons."""
    head, inner = schema.split("struct<", 1)
    body = inner.rsplit(">>", 1)[0]
    return head + "struct<" + ", ".join("{}:{}".format(*p.strip().split(" ", 1)) for p in body.split(",")) + ">>"


def load_regulations(spark: SparkSession, path: str) -> DataFrame:
    """Regulation items from JSON (`items` list) or parquet with an `ord` column."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return load_dim(spark, path, "regulations")


def read_players(spark: SparkSession, path: str) -> DataFrame:
    """Player rows of a JSON-lines file whose meta row is left out."""
    return spark.read.schema(PLAYER_SCHEMA).json(path).where(F.col("_meta").isNull()).drop(
        "_meta", "season", "captured_at", "player_count"
    )


def players_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAYER_SCHEMA).json(path).where(F.col("_meta")).select("season", "captured_at", "player_count")


def write_players(players: DataFrame, path: str, *, season: int, captured_at: str) -> None:
    """Deduplicated players sorted inside each team, one folder per team, and a separate meta row."""
    from corvane.operators.league import dedupe_players

    unique = dedupe_players(players)
    kind = F.when(F.col("player_type") == "HITTER", 0).when(F.col("player_type") == "PITCHER", 1).otherwise(9)
    games = F.coalesce("stats.games", F.lit(0))
    (
        unique.repartition("team_code")
        .sortWithinPartitions("team_code", kind, F.desc(games), "name")
        .write.mode("overwrite").partitionBy("team_code").json(f"{path}/players")
    )
    meta = unique.agg(F.count(F.lit(1)).alias("player_count")).select(
        F.lit(True).alias("_meta"), F.lit(season).alias("season"), F.lit(captured_at).alias("captured_at"), "player_count"
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_chunks(chunks: DataFrame, path: str, *, mode: str = "append") -> None:
    """Chunk table in folders by document, so a read for one document touches only its folder."""
    chunks.write.mode(mode).partitionBy("document_id").parquet(path)


def write_documents(documents: DataFrame, path: str, *, mode: str = "append") -> None:
    documents.write.mode(mode).parquet(path)


def read_chunks(spark: SparkSession, path: str, *, with_vectors: bool = False) -> DataFrame:
    """Chunks without their vectors unless asked, so the vector column is not read."""
    chunks = spark.read.parquet(path)
    return chunks if with_vectors or "embedding" not in chunks.columns else chunks.drop("embedding")


def write_glossary(glossary: DataFrame, path: str) -> None:
    glossary.select("term_no", "term_en", "term_ko", "rule_id", "page", "aliases").coalesce(1).sortWithinPartitions(
        "term_no"
    ).write.mode("overwrite").json(path)


def glossary_snapshot(glossary: DataFrame, index_version: str, source_url: str) -> DataFrame:
    """One snapshot row with the glossary as JSON; a glossary is a small dimension."""
    entry = F.struct("term_no", "term_en", "term_ko", "rule_id", "page", "aliases")
    return glossary.agg(F.array_sort(F.collect_list(entry)).alias("items")).select(
        F.lit("glossary").alias("kind"),
        F.to_json(F.struct("items", F.lit(index_version).alias("index_version"))).alias("payload"),
        F.lit(None).cast("date").alias("as_of"),
        F.lit(source_url).alias("source_url"),
        F.current_timestamp().alias("fetched_at"),
    )


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return load_dim(spark, path, "golden")


def write_eval_report(summary: DataFrame, cases: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    cases.write.mode("overwrite").json(f"{path}/cases")
