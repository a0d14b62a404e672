"""Chains of jumps: which rows are reached from the first row of a piece by following pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import stored_table


def reached(nodes: DataFrame, keys: list[str], at: str, to: str, first: str) -> DataFrame:
    """(keys, at) of the rows that a walk from each piece's `first` row stops at, going from `at` to `to`.

    nodes(keys, at, to, first): one row for each place, `to` is null where the walk ends. Pointers are doubled: round
    t joins what is known with jumps of 2**t steps and the jumps with themselves, so a chain of n stops takes log2(n)
    doublings. Joins are by (keys, place), which are different for every row, so a chain of any length spreads over all
    tasks. Each round is stored.
    """
    def go(stops: DataFrame, jumps: DataFrame) -> DataFrame:
        return stops.join(jumps, [*keys, at]).select(*keys, F.col(to).alias(at))

    def twice(jumps: DataFrame) -> DataFrame:
        ahead = jumps.select(*keys, F.col(at).alias(to), F.col(to).alias("_next"))
        return jumps.join(ahead, [*keys, to]).select(*keys, at, F.col("_next").alias(to))

    one = nodes.where(F.col(to).isNotNull()).select(*keys, at, to)
    seen = nodes.where(first).select(*keys, at)
    # Two doublings in each stored step: chains of 4, 16, 64, ... stops.
    while True:
        two = twice(one)
        new = go(seen, one)
        new = stored_table(new.unionByName(go(seen.unionByName(new), two)), "seen")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        one = stored_table(twice(two), "jumps")
