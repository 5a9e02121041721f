"""First-fit edge coloring in input order."""

from __future__ import annotations

from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from arcweave.session import materialize

if TYPE_CHECKING:
    from collections.abc import Iterator

    from pyspark.sql import DataFrame

MOST_EDGES = 50_000_000   # of a component whose edges stream through one task
_COLORED = "edge_id bigint, src string, dst string, color int, component string"


def components(edges: DataFrame) -> DataFrame:
    """``(title, component)``: the smallest title of each connected component, by label propagation.

    Each round every title takes the smallest label among itself and its
    neighbours, and then that label's own label; lineage is cut every round.
    """
    near = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = materialize(near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).select(F.col("src").alias("title"), "label"))
    while True:
        offered = near.join(labels.withColumnRenamed("title", "dst"), "dst").groupBy(F.col("src").alias("title")).agg(F.min("label").alias("offer"))
        step = labels.join(offered, "title").select("title", F.least("label", "offer").alias("new"), "label")
        jump = labels.select(F.col("title").alias("new"), F.col("label").alias("further"))
        new = materialize(step.join(jump, "new", "left").select("title", F.least("new", F.coalesce("further", "new")).alias("next"), "label"))
        changed = new.where("next < label").limit(1).count()
        labels = new.select("title", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Colors of edges sorted by component and id: the lowest bit that neither end's mask of used colors has.

    The edges stream; only the masks of one component's ends are held.
    """
    now, used = None, {}
    for batch in batches:
        colors = []
        for u, v, part in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            if part != now:
                now, used = part, {}
            taken = used.get(u, 0) | used.get(v, 0)
            bit = ~taken & (taken + 1)
            used[u] = used.get(u, 0) | bit
            used[v] = used.get(v, 0) | bit
            colors.append(bit.bit_length() - 1)
        yield pa.record_batch([*batch.columns[:3], pa.array(colors, pa.int32()), batch.column(3)], names=["edge_id", "src", "dst", "color", "component"])


def _rounds(edges: DataFrame) -> DataFrame:
    """The same coloring by rounds, for components too large for one task.

    In each round the edges that come first at both their ends among the uncolored
    take the lowest color free at both; such edges share no end, and everything
    before them is colored, so the result is that of the sequential rule.
    """
    spark = edges.sparkSession
    done, left = spark.createDataFrame([], _COLORED), materialize(edges.select("edge_id", "src", "dst", "component"))
    while left.limit(1).count():
        ends = left.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("title"), "edge_id")
        first = ends.groupBy("title").agg(F.min("edge_id").alias("edge_id"))
        ready = left.join(first.groupBy("edge_id").agg(F.count(F.lit(1)).alias("_n")), "edge_id").where(F.col("_n") == F.when(F.col("src") == F.col("dst"), 1).otherwise(2))
        ready = ready.drop("_n")
        used = done.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("title"), "color")
        taken = ready.select("edge_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("title")).join(used, "title").select("edge_id", "color").distinct()
        # lowest free color: the first place at which the sorted used colors differ from 0, 1, 2, ...
        place = taken.withColumn("_p", F.row_number().over(Window.partitionBy("edge_id").orderBy("color")) - 1)
        free = place.groupBy("edge_id").agg(F.coalesce(F.min(F.when(F.col("color") != F.col("_p"), F.col("_p"))), F.count(F.lit(1))).cast("int").alias("color"))
        now = ready.join(free, "edge_id", "left").select("edge_id", "src", "dst", F.coalesce("color", F.lit(0)).alias("color"), "component")
        done = materialize(done.unionByName(now))
        left = materialize(left.join(now.select("edge_id"), "edge_id", "left_anti"))
    return done


def color_edges(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """``(edge_id, src, dst, color, component)``: each edge's smallest color that no earlier edge at its ends has.

    ``edge_id`` gives the order and must be unique. Edges with a null end are left
    out; self links take part once. First-fit coloring is sequential within a
    component: the sorted edges of one of up to ``most`` edges stream through one task,
    which holds only the colors used at its ends (a hub of n links takes n bits).
    Larger components are colored in rounds over all executors, one color a hub and
    round.
    """
    whole = materialize(edges.where("src is not null and dst is not null").select("edge_id", "src", "dst"))
    labeled = materialize(whole.join(components(whole).withColumnRenamed("title", "src"), "src").select("edge_id", "src", "dst", "component"))
    large = [r["component"] for r in labeled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component").collect()]
    small = labeled.where(~F.col("component").isin(large)) if large else labeled
    sorted_ = small.repartition("component").sortWithinPartitions("component", "edge_id")
    out = sorted_.select("edge_id", "src", "dst", "component").mapInArrow(fold, _COLORED)
    return out.unionByName(_rounds(labeled.where(F.col("component").isin(large)))) if large else out


def _violations(rows: pd.DataFrame) -> pd.DataFrame:
    seen: dict[str, int] = {}
    repeats = wrong = 0
    for u, v, c in rows.sort_values("edge_id")[["src", "dst", "color"]].itertuples(index=False):
        mask, below = seen.get(u, 0) | seen.get(v, 0), (1 << c) - 1
        repeats += mask >> c & 1
        wrong += mask & below != below
        for end in (u, v):
            seen[end] = seen.get(end, 0) | 1 << c
    return pd.DataFrame({"endpoint_repeats": [repeats], "order_violations": [wrong]})


def color_violations(colored: DataFrame) -> DataFrame:
    """One row ``(endpoint_repeats, order_violations)``; both 0 for a first-fit coloring and only for it.

    Repeats: edges whose color an earlier edge at their ends has. Violations: edges
    with a smaller color that no earlier edge at their ends has. ``colored`` is the
    result of ``color_edges`` with components of bounded size.
    """
    counts = colored.groupBy("component").applyInPandas(_violations, "endpoint_repeats bigint, order_violations bigint")
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("endpoint_repeats", "order_violations")))


def color_count(colored: DataFrame) -> DataFrame:
    """``(n_colors, n_edges, largest)``: one row; ``largest`` is the size of the most used color."""
    sizes = colored.groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return sizes.agg(F.count(F.lit(1)).alias("n_colors"), zero(F.sum("n"), "n_edges"), zero(F.max("n"), "largest"))
