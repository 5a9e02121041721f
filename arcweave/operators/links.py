"""Building, uniting and deduplicating links."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """``(src, dst, *keep)``: one link from a page's title to each of its entities, repeated elements of a row once.

    Null titles, null lists and null elements give no link; columns named in ``keep`` stay.
    """
    found = pages.where("title is not null").select(F.col("title").alias("src"), F.explode(F.array_distinct("entities")).alias("dst"), *keep)
    return found.where("dst is not null")


def union_links(*parts: DataFrame) -> DataFrame:
    """``(source_rank, edge_id, src, dst)``: all parts one after the other, earlier parts ranked first."""
    ranked = [p.select(F.lit(k).alias("source_rank"), "edge_id", "src", "dst") for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), ranked)


def first_links(links: DataFrame) -> DataFrame:
    """``(src, dst, source_rank, edge_id)``: the first occurrence of each pair; null ends equal each other.

    Direction counts and self links stay. One partial aggregation, so repeats of a
    heavy pair never travel.
    """
    place = F.min(F.struct("source_rank", "edge_id"))
    return links.groupBy("src", "dst").agg(place.alias("p")).select("src", "dst", "p.source_rank", "p.edge_id")
