"""Graph upsert: nodes by title, weighted directed links, reset and statistics."""

from __future__ import annotations

import json
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave import schema
from arcweave.session import materialize

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


def complete(edges: DataFrame) -> DataFrame:
    """Edges with both ends; a null end can't be merged and is left out."""
    return edges.where("src is not null and dst is not null")


def merge_nodes(nodes: DataFrame, edges: DataFrame, clock: int) -> DataFrame:
    """Nodes after the load: new titles are not base and stamped ``clock``.

    Nodes that the load touches get null fields filled, others keep them. Repeated
    titles in ``nodes`` must have been merged before; null titles are never touched.
    """
    touched = complete(edges).select(F.explode(F.array("src", "dst")).alias("title")).distinct().withColumn("_hit", F.lit(True))
    joined = touched.join(nodes.select("title", "is_base", "processed_at"), "title", "full_outer")
    fill = lambda c, v: F.when(F.col("_hit"), F.coalesce(c, F.lit(v))).otherwise(F.col(c)).alias(c)
    return joined.select("title", fill("is_base", False), fill("processed_at", clock).cast("bigint").alias("processed_at"))


def merge_links(links: DataFrame, edges: DataFrame, clock: int) -> DataFrame:
    """Links after the load: n occurrences of a pair add n to its weight.

    A new pair is created at ``clock`` and updated then if it occurs again in the
    load; a known pair keeps its creation and, if it occurs, is updated. A null
    weight stays null.
    """
    new = complete(edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
    joined = new.join(links.select("src", "dst", "weight", "created_at", "last_updated").withColumn("_old", F.lit(True)), ["src", "dst"], "full_outer")
    n, old = F.col("_n"), F.col("_old").isNotNull()
    now = F.lit(clock).cast("bigint")
    return joined.select(
        "src", "dst",
        F.when(old & n.isNotNull(), F.col("weight") + n).when(old, F.col("weight")).otherwise(n).alias("weight"),
        F.when(old, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(n.isNull(), F.col("last_updated")).when(old | (n > 1), now).alias("last_updated"),
    )


def reset_nodes(nodes: DataFrame) -> DataFrame:
    """Base nodes only; a null flag is not base."""
    return nodes.where(F.coalesce("is_base", F.lit(False)))


def reset_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links between two base nodes.

    The base titles are written first: beside a table the adaptive planner splits the
    links of a hot end, beside an aggregate it could not.
    """
    base = materialize(reset_nodes(nodes).select("title").distinct())
    for end in ("src", "dst"):
        links = links.join(base.withColumnRenamed("title", end), end, "left_semi")
    return links


def graph_stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(n_nodes, n_links, total_weight, degree_sum)``: one row; each directed link counts once.

    ``degree_sum`` counts a link at both its ends, a self link at its one end. Links
    with a null end, which no load makes, count as links between two ends.
    """
    a = nodes.agg(F.countDistinct("title").alias("n_nodes")).withColumn("_k", F.lit(0))
    loops = F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("_loops")
    b = links.agg(F.count(F.lit(1)).alias("n_links"), loops, F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight")).withColumn("_k", F.lit(0))
    return a.join(b, "_k").select("n_nodes", "n_links", "total_weight", (2 * F.col("n_links") - F.col("_loops")).alias("degree_sum"))


_COUNTS = "src string, dst string, n bigint, at bigint, seq bigint"
MOST_DELTAS = 16   # loads kept beside the snapshot before they are merged into a new one


def fold_links(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``merge_links`` of several loads at once: ``counts`` has one row ``(src, dst, n, at, seq)`` a pair and load, ``seq`` in load order."""
    new = counts.groupBy("src", "dst").agg(
        F.sum("n").alias("_n"), F.min_by("at", "seq").alias("_first"), F.max_by("at", "seq").alias("_last"), F.count(F.lit(1)).alias("_loads")
    )
    joined = new.join(links.select("src", "dst", "weight", "created_at", "last_updated").withColumn("_old", F.lit(True)), ["src", "dst"], "full_outer")
    n, old = F.col("_n"), F.col("_old").isNotNull()
    return joined.select(
        "src", "dst",
        F.when(old & n.isNotNull(), F.col("weight") + n).when(old, F.col("weight")).otherwise(n).alias("weight"),
        F.when(old, F.col("created_at")).otherwise(F.col("_first")).alias("created_at"),
        F.when(n.isNull(), F.col("last_updated")).when(old | (n > 1), F.col("_last")).alias("last_updated"),
    )


def fold_nodes(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """``merge_nodes`` of several loads at once, ``counts`` as in ``fold_links``; the first load that touches a title stamps it."""
    ends = counts.select(F.explode(F.array("src", "dst")).alias("title"), "at", "seq")
    touched = ends.groupBy("title").agg(F.min_by("at", "seq").alias("_at"))
    joined = touched.join(nodes.select("title", "is_base", "processed_at"), "title", "full_outer")
    hit = F.col("_at").isNotNull()
    return joined.select(
        "title", F.when(hit, F.coalesce("is_base", F.lit(False))).otherwise(F.col("is_base")).alias("is_base"),
        F.when(hit, F.coalesce("processed_at", "_at")).otherwise(F.col("processed_at")).alias("processed_at"),
    )


class GraphStore:
    """Nodes and links in a shared folder: a parquet snapshot and the loads since.

    A load writes only its own pair counts; reading folds them into the snapshot, and
    every MOST_DELTAS loads a new snapshot is written. Each change ends in one log
    entry, written beside and then renamed, so it is there whole or not at all and a
    failed load changes nothing. A load may carry the number of a stream's batch; the
    entry keeps the last one, and a batch that comes again is left out. What the last
    two entries do not name is removed. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _entries(self) -> list[str]:
        fs, path = self._file("log")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.endswith(".json"))

    def _state(self, name: str | None = None) -> dict:
        name = name or next(reversed(self._entries()), None)
        if name is None:
            return {"seq": 0, "base": None, "loads": [], "batches": {}}
        fs, path = self._file(f"log/{name}")
        stream = fs.open(path)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        name = f"{state['seq']:012d}.json"
        fs, beside = self._file(f"log/.{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        try:
            stream.writeUTF(json.dumps(state))
        finally:
            stream.close()
        if not fs.rename(beside, self._file(f"log/{name}")[1]):
            raise RuntimeError(f"another writer committed {name}")
        *old, before, now = [None, None, *self._entries()]
        kept = set()
        for entry in filter(None, (before, now)):
            held = self._state(entry)
            kept |= {held["base"], *held["loads"]}
        for entry in filter(None, old):
            gone = self._state(entry)
            for part in {gone["base"], *gone["loads"]} - kept - {None}:
                fs.delete(self._file(part)[1], True)
            fs.delete(self._file(f"log/{entry}")[1], False)

    def _base(self, state: dict, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{state['base']}/{name}") if state["base"] else self.spark.createDataFrame([], kind)

    def _counts(self, state: dict) -> DataFrame | None:
        paths = [f"{self.folder}/{x}/counts" for x in state["loads"]]
        return self.spark.read.schema(_COUNTS).parquet(*paths) if paths else None

    def _nodes(self, state: dict) -> DataFrame:
        base, counts = self._base(state, "nodes", schema.NODES), self._counts(state)
        return base if counts is None else fold_nodes(base, counts)

    def _links(self, state: dict) -> DataFrame:
        base, counts = self._base(state, "links", schema.LINKS), self._counts(state)
        return base if counts is None else fold_links(base, counts)

    def nodes(self) -> DataFrame:
        return self._nodes(self._state())

    def links(self) -> DataFrame:
        return self._links(self._state())

    def _snapshot(self, nodes: DataFrame, links: DataFrame) -> str:
        version = uuid.uuid4().hex
        nodes.write.parquet(f"{self.folder}/{version}/nodes")
        links.write.parquet(f"{self.folder}/{version}/links")
        return version

    def replace(self, nodes: DataFrame, links: DataFrame) -> None:
        state = self._state()
        self._commit({**state, "seq": state["seq"] + 1, "base": self._snapshot(nodes, links), "loads": []})

    def merge(self, edges: DataFrame, clock: int, stream: str | None = None, batch: int | None = None) -> bool:
        """Load edges; false, and nothing is done, if this or a later ``batch`` of ``stream`` has been loaded."""
        state = self._state()
        if stream is not None and batch is not None:
            if state["batches"].get(stream, -1) >= batch:
                return False
            state = {**state, "batches": {**state["batches"], stream: batch}}
        seq, load = state["seq"] + 1, uuid.uuid4().hex
        counts = complete(edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        counts.select("*", F.lit(clock).cast("bigint").alias("at"), F.lit(seq).cast("bigint").alias("seq")).write.parquet(f"{self.folder}/{load}/counts")
        state = {**state, "seq": seq, "loads": [*state["loads"], load]}
        if len(state["loads"]) > MOST_DELTAS:
            state = {**state, "base": self._snapshot(self._nodes(state), self._links(state)), "loads": []}
        self._commit(state)
        return True

    def reset(self) -> None:
        state = self._state()
        nodes, links = self._nodes(state), self._links(state)
        self.replace(reset_nodes(nodes), reset_links(nodes, links))

    def stats(self) -> DataFrame:
        state = self._state()
        return graph_stats(self._nodes(state), self._links(state))
