"""Table access shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects a module's queries and SQL under their names."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def sql_rule_numbers(text: str) -> str:
    """Rule numbers in SQL without lookaround: whole runs of digits and dots."""
    return rf"list_filter(regexp_split_to_array({text}, '[^0-9.]+'), lambda t: regexp_full_match(t, '[1-9]\.[0-9][0-9]'))"


def sql_words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]{{2,}}|[\p{{Latin}}\p{{N}}\p{{Han}}]')"


def sql_tokens(text: str) -> str:
    return f"list_concat({sql_words(text)}, {sql_rule_numbers(text)})"
