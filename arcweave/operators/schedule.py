"""Loading schedules: which wave, lane and step each edge is loaded in.

A schedule is a pure function of an immutable edge table with ``edge_id``; numbers
inside waves and cells come from one range sort, never from one task.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave.operators.dictionary import number_rows

if TYPE_CHECKING:
    from collections.abc import Callable

    from pyspark.sql import Column, DataFrame

BATCH, PARTITIONS, HASH_DIGITS, SEED = 1000, 10, 1, 42


def shuffled(seed: int = SEED) -> Column:
    """A seeded order that any engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("edge_id").cast("string")))


def partition_id(name: Column, n: int = PARTITIONS, digits: int = HASH_DIGITS) -> Column:
    """Last ``digits`` digits of a name (all if 0) modulo n; without ASCII digits the first
    eight places of its md5 modulo n; null for null."""
    numbers = F.regexp_replace(name, "[^0-9]", "")
    kept = F.right(numbers, F.lit(digits)) if digits else numbers
    bucket = F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint"), F.lit(n))
    number = F.when(name.rlike("[0-9]"), F.pmod(kept.try_cast("bigint"), F.lit(n)))
    return F.coalesce(number, bucket).cast("int")


def with_codes(edges: DataFrame, n: int = PARTITIONS, digits: int = HASH_DIGITS) -> DataFrame:
    """Edges with ``i``, ``j`` (partition of either end) and ``code`` ``"i-j"``."""
    coded = edges.withColumns({"i": partition_id(F.col("src"), n, digits), "j": partition_id(F.col("dst"), n, digits)})
    return coded.withColumn("code", F.concat_ws("-", "i", "j"))


def diagonal(n: int = PARTITIONS) -> Column:
    return F.pmod(F.col("j") - F.col("i"), F.lit(n)).cast("int")


def _numbered(edges: DataFrame, by: list, order: Column, name: str = "_at") -> DataFrame:
    """0-based place inside each group of ``by``, by ``order`` (unique): one global sort, then minus the group's first place."""
    numbered = number_rows(edges.withColumn("_o", order).orderBy(*by, "_o"), "_g").drop("_o")
    if not by:
        return numbered.withColumnRenamed("_g", name)
    first = numbered.groupBy(*by).agg(F.min("_g").alias("_f"))
    return numbered.join(F.broadcast(first), by).withColumn(name, F.col("_g") - F.col("_f")).drop("_g", "_f")


def _columns(edges: DataFrame, wave: Column, lane: Column, step: Column) -> DataFrame:
    return edges.select("edge_id", "src", "dst", wave.cast("bigint").alias("wave"), lane.cast("bigint").alias("lane"), step.cast("bigint").alias("step"))


def sequential(edges: DataFrame, batch: int = BATCH) -> DataFrame:
    """Input order; one batch after the other."""
    rows = _numbered(edges.select("edge_id", "src", "dst"), [], F.col("edge_id"))
    return _columns(rows, F.floor(F.col("_at") / batch), F.lit(0), F.lit(0))


def naive_parallel(edges: DataFrame, batch: int = BATCH, seed: int = SEED) -> DataFrame:
    """Shuffled batches, all at once."""
    rows = _numbered(edges.select("edge_id", "src", "dst"), [], shuffled(seed))
    return _columns(rows, F.lit(0), F.floor(F.col("_at") / batch), F.lit(0))


def batched_parallel(edges: DataFrame, batch: int = BATCH) -> DataFrame:
    """Batches in input order, all at once, as a server-side batch call does."""
    rows = _numbered(edges.select("edge_id", "src", "dst"), [], F.col("edge_id"))
    return _columns(rows, F.lit(0), F.floor(F.col("_at") / batch), F.lit(0))


def mix_and_batch(edges: DataFrame, batch: int = BATCH, n: int = PARTITIONS, digits: int = HASH_DIGITS) -> DataFrame:
    """One diagonal of the partition grid after the other, its cells at once, batches of a cell one by one.

    The n * n cells are a short list, so their first places are broadcast.
    """
    coded = with_codes(edges.where("src is not null and dst is not null").select("edge_id", "src", "dst"), n, digits).drop("code")
    rows = _numbered(coded, ["i", "j"], F.col("edge_id"))
    return _columns(rows, diagonal(n), F.col("i"), F.floor(F.col("_at") / batch))


def color_batch(colored: DataFrame, batch: int = BATCH) -> DataFrame:
    """One color after the other, its batches at once; ``colored`` has ``color``."""
    place = number_rows(colored.select("edge_id", "src", "dst", "color").orderBy("color", "edge_id"), "_g")
    first = place.groupBy("color").agg(F.min("_g").alias("_f"))
    rows = place.join(first, "color").withColumn("_at", F.col("_g") - F.col("_f"))
    return _columns(rows, F.col("color"), F.floor(F.col("_at") / batch), F.lit(0))


#: Strategies by name; each takes edges (the last one colored edges) and a batch size.
STRATEGIES: dict[str, Callable] = {
    "sequential": sequential, "naive_parallel": naive_parallel, "mix_and_batch": mix_and_batch,
    "batched_parallel": batched_parallel, "batched_sequential": sequential, "color_batch": color_batch,
}


def contention(schedule: DataFrame) -> DataFrame:
    """``(entity, wave, lanes)``: entities that more than one lane of a wave touches."""
    ends = schedule.select(F.explode(F.array("src", "dst")).alias("entity"), "wave", "lane").distinct()
    return ends.groupBy("entity", "wave").agg(F.count(F.lit(1)).alias("lanes")).where("lanes > 1")


def batch_sizes(schedule: DataFrame) -> DataFrame:
    """``(wave, lane, step, n)``."""
    return schedule.groupBy("wave", "lane", "step").agg(F.count(F.lit(1)).alias("n"))
