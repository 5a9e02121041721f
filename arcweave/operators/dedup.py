"""Distinct rows of tables with long texts."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave.session import materialize

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

SEEN_TWICE = 500_000   # hashes of repeated rows that are broadcast


def once(rows: DataFrame) -> DataFrame:
    """The distinct rows of a table with texts, which are shuffled only where their hash was seen twice.

    What has a hash of its own is distinct. The hashes seen twice are broadcast up to
    SEEN_TWICE of them, beyond that they meet the rows in a shuffle.
    """
    keyed = rows.withColumn("_k", F.xxhash64(*rows.columns))
    again = materialize(keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k"))
    twice = F.broadcast(again) if again.count() <= SEEN_TWICE else again
    single = keyed.join(twice, "_k", "left_anti").drop("_k")
    return single.unionByName(keyed.join(twice, "_k", "left_semi").drop("_k").distinct())
