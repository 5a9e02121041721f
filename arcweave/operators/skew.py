"""Per-key results without the imbalance of a few very heavy keys."""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

from pyspark.sql import Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from collections.abc import Sequence

    from pyspark.sql import Column, DataFrame, SparkSession

MERGERS = 64    # tasks that merge the sketches of all others
FINEST = 2000   # a share below 1 in so many would make the sketches of all tasks too large to merge


def fair_share(spark: SparkSession, coarsest: int = 200) -> float:
    """Share of the rows above which a key is heavy: a quarter of what a shuffle partition holds.

    At least 1 in FINEST, at most 1 in ``coarsest``. A key below it fills no partition
    out of proportion; joins on it are split further by the adaptive planner.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return 1 / min(FINEST, max(coarsest, 4 * parts))


def not_blank(c: Column | str) -> Column:
    """True unless the value is null, empty or spaces only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c) != "", F.lit(False))


def key_candidates(df: DataFrame, key: Column, share: float) -> tuple[list, int]:
    """Values that may hold at least ``share`` of the rows, and the row count.

    A frequent-items sketch is merged over all rows, map side first, then in
    MERGERS tasks, then in one. Its error is under a tenth of ``share``, so no
    value at or above ``share`` is missing; at most ``2 / share`` values come back, which
    bounds what a caller may broadcast. Null keys are not counted.
    """
    k = math.ceil(2 / share)
    tracked = F.lit(max(64, 1 << math.ceil(math.log2(35 / share))))
    call, n = F.call_function, F.count(F.lit(1)).alias("n")
    some = df.where(key.isNotNull()).select(key.alias("k"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("m"))
    merged = some.groupBy("m").agg(call("approx_top_k_accumulate", F.col("k"), tracked).alias("s"), n)
    whole = merged.groupBy(F.lit("").alias("_")).agg(call("approx_top_k_combine", F.col("s"), tracked).alias("s"), F.sum("n").alias("n"))
    row = whole.select(call("approx_top_k_estimate", F.col("s"), F.lit(k)).alias("top"), "n").first()
    if row is None:
        return [], 0
    return [x["item"] for x in row["top"] or [] if 2 * x["count"] >= share * row["n"]], row["n"]


def heavy_hitters(df: DataFrame, key: str, share: float = 1 / 200) -> DataFrame:
    """``(key, n)`` for every value that holds at least ``share`` of the keyed rows.

    Null keys neither count nor come out; an empty input gives no rows. The
    sketch proposes, an exact count over the whole input decides.
    """
    values, n = key_candidates(df, F.col(key), share)
    spark = df.sparkSession
    names = spark.createDataFrame([(v,) for v in values], f"`{key}` {df.schema[key].dataType.simpleString()}")
    return (
        df.select(key).join(F.broadcast(names), key, "left_semi")
        .groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= share * n)
    )


def split_join(left: DataFrame, right: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """Inner join on ``key`` where a few values hold most rows of ``left``.

    ``right`` has one row per key. Its rows for the heavy values of ``left``
    (at most ``2 / share`` of them) are broadcast, all others meet ``left`` in an
    ordinary shuffle join, and the two parts are united. Null keys match nothing.
    Columns of both sides other than ``key`` must have different names. ``share`` is
    ``fair_share`` if it is not given.
    """
    values, _ = key_candidates(left, F.col(key), share or fair_share(left.sparkSession))
    if not values:
        return left.join(right, key)
    spark = left.sparkSession
    names = F.broadcast(spark.createDataFrame([(v,) for v in values], f"`{key}` {left.schema[key].dataType.simpleString()}"))
    heavy = left.join(F.broadcast(right.join(names, key, "left_semi")), key)
    light = left.join(names, key, "left_anti").join(right, key)
    return heavy.unionByName(light)


def target_report(
    links: DataFrame, key: str = "dst", source: str = "src", hubs: int = 10, share: float | None = None, salts: int = 64,
) -> DataFrame:
    """Links, linking pages and leading hubs of every target.

    One row ``(key, n_links, n_src, hubs)`` per non-blank target: ``n_links``
    counts rows, ``n_src`` different non-blank sources, ``hubs`` joins the
    ``hubs`` sources with most links (ties by name) as ``name=links`` with `` | ``;
    it is empty where no source is given. Repeated rows count again, blank
    sources only in ``n_links``. An empty table gives no rows.

    Rows are first reduced to one per (target, source). Targets that the sketch
    calls heavy (``share`` of the rows, ``fair_share`` if not given) are spread over ``salts`` sub-groups by a broadcast join, ranked
    there and ranked again over the survivors; all others are ranked after one
    ordinary shuffle; the two parts are united.
    """
    rows = links.where(not_blank(key)).select(
        F.col(key).alias("k"), F.when(not_blank(source), F.col(source)).alias("s")
    )
    values, _ = key_candidates(rows, F.col("k"), share or fair_share(links.sparkSession))
    names = F.broadcast(links.sparkSession.createDataFrame([(v,) for v in values], "k string"))
    pairs = rows.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"))

    def ranked(part: DataFrame, by: Sequence[str], keep: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.when(F.col("s").isNotNull(), F.col("n"))), "s")
        return part.withColumn("r", F.row_number().over(w)).withColumn("top", (F.col("r") <= hubs) & F.col("s").isNotNull() & keep)

    def summed(part: DataFrame, by: Sequence[str]) -> DataFrame:
        leaders = F.collect_list(F.when(F.col("top"), F.struct((-F.col("n")).alias("m"), F.col("s").alias("s"))))
        return part.groupBy(*by).agg(F.sum("n").alias("n_links"), F.count("s").alias("n_src"), leaders.alias("lead"))

    light = summed(ranked(pairs.join(names, "k", "left_anti"), ["k"], F.lit(True)), ["k"])
    parts = light
    if values:
        salted = pairs.join(names, "k", "left_semi").withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(salts)))
        first = summed(ranked(salted, ["k", "salt"], F.lit(True)), ["k", "salt"])
        heavy = first.groupBy("k").agg(
            F.sum("n_links").alias("n_links"), F.sum("n_src").alias("n_src"), F.flatten(F.collect_list("lead")).alias("lead")
        )
        parts = light.unionByName(heavy)
    best = F.slice(F.array_sort("lead"), 1, hubs)
    shown = F.array_join(F.transform(best, lambda x: F.concat(x["s"], F.lit("="), (-x["m"]).cast("string"))), " | ")
    return parts.select(F.col("k").alias(key), "n_links", "n_src", shown.alias("hubs"))


def shared_targets(links: DataFrame, share: float = 1 / 200, key: str = "dst", source: str = "src") -> DataFrame:
    """``(key, n_links, n_src)`` of the targets that hold at least ``share`` of all rows with a non-blank target.

    They are read off the report of all targets, heavy and light ones alike.
    """
    report = target_report(links, key, source, hubs=1).select(key, "n_links", "n_src")
    total = links.where(not_blank(key)).count()
    return report.where(F.col("n_links") >= F.lit(share) * total)


def target_hubs(links: DataFrame, key: str = "dst", source: str = "src") -> DataFrame:
    """``(key, source, n)``: every non-blank source of every non-blank target with its number of links.

    The whole hub lists, of which ``target_report`` shows the first. Rows are counted
    per pair, map side first, so no task holds all links of a heavy target.
    """
    return links.where(not_blank(key) & not_blank(source)).groupBy(key, source).agg(F.count(F.lit(1)).alias("n"))
