"""Hotspot scenarios: top hubs and the cliques of their targets."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcweave.operators.skew import not_blank

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

SINGLE_CAP, TOP_HUBS, TOP_CAP = 200, 40, 60


def hub_degrees(links: DataFrame) -> DataFrame:
    """``(src, degree)``: different targets of each source; blank ends count for nothing."""
    pairs = links.where(not_blank("src") & not_blank("dst")).select("src", "dst").distinct()
    return pairs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def top_hubs(links: DataFrame, k: int = TOP_HUBS) -> DataFrame:
    """The ``k`` sources with most different targets, ties by name."""
    return hub_degrees(links).orderBy(F.desc("degree"), "src").limit(k)


def hub_targets(links: DataFrame, hubs: DataFrame, cap: int) -> DataFrame:
    """``(src, dst)``: the first ``cap`` different targets by name of each hub; ``hubs`` is a short list and broadcast.

    A hub may hold very many links: targets are first reduced in sub-groups, and
    only their survivors are ranked hub by hub.
    """
    pairs = links.where(not_blank("src") & not_blank("dst")).join(F.broadcast(hubs.select("src")), "src", "left_semi").select("src", "dst").distinct()
    salted = pairs.withColumn("_s", F.pmod(F.xxhash64("dst"), F.lit(64)))
    for by in (["src", "_s"], ["src"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("dst"))
        salted = salted.withColumn("_r", rank).where(F.col("_r") <= cap)
    return salted.select("src", "dst")


def cliques(targets: DataFrame) -> DataFrame:
    """``(hub, src, dst)``: all ordered pairs of different targets of each hub.

    At most cap * (cap - 1) rows a hub by construction of ``hub_targets``. Pairs that
    several hubs give stay repeated.
    """
    a = targets.select(F.col("src").alias("hub"), F.col("dst").alias("src"))
    b = targets.select(F.col("src").alias("hub"), F.col("dst"))
    return a.join(b, "hub").where("src <> dst")


def single_hub_scenario(links: DataFrame, hub: str, cap: int = SINGLE_CAP) -> DataFrame:
    """Clique of one named hub; an unknown hub gives no rows."""
    own = links.where(F.col("src") == hub)
    return cliques(hub_targets(own, own.select("src").distinct(), cap))


def top_hubs_scenario(links: DataFrame, k: int = TOP_HUBS, cap: int = TOP_CAP) -> DataFrame:
    """Cliques of the ``k`` largest hubs."""
    return cliques(hub_targets(links, top_hubs(links, k), cap))


def clique_sizes(targets: DataFrame) -> DataFrame:
    """``(src, n_targets, n_edges)`` with n(n-1) edges."""
    n = F.count(F.lit(1))
    return targets.groupBy("src").agg(n.alias("n_targets"), (n * (n - 1)).alias("n_edges"))
