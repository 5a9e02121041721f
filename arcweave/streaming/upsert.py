"""Links that arrive as a stream, merged into the graph batch by batch."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

if TYPE_CHECKING:
    from collections.abc import Callable

    from pyspark.sql import DataFrame
    from pyspark.sql.streaming import StreamingQuery

    from arcweave.operators.graph import GraphStore


def merge_stream(edges: DataFrame, store: GraphStore, checkpoint: str, clock: Callable[[int], int] = int) -> StreamingQuery:
    """Merge every micro-batch of a streaming edge table into ``store`` and end when no more is there.

    The result equals one merge of all edges but for the stamps, which come from
    ``clock`` (given the batch number). The store remembers the last batch of each
    ``checkpoint``, so one that is replayed after a failure adds nothing; a batch
    writes its own pairs, not the graph.
    """
    return (
        edges.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: store.merge(batch, clock(number), checkpoint, number) and None).start()
    )


def windowed_links(edges: DataFrame, at: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(window, src, dst, n)`` counts of a streaming or finite edge table; rows later than ``late`` are dropped from a stream."""
    timed = edges.withWatermark(at, late) if edges.isStreaming else edges
    return timed.groupBy(F.window(at, width), "src", "dst").agg(F.count(F.lit(1)).alias("n"))
