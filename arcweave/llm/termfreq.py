"""Frequency of every distinct term: global dictionary and blockwise count arrays."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arcweave.operators.dictionary import number_rows
from arcweave.operators.skew import fair_share, key_candidates, not_blank

if TYPE_CHECKING:
    from collections.abc import Iterator

    from pyspark.sql import DataFrame

RANGE = 1 << 14
HELD = 256
_PARTIAL = "range bigint, at array<int>, occurrences array<bigint>, records array<bigint>"


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded rows (id, n, in_record) to count arrays by identifier range.

    At most HELD ranges are held; beyond that the arrays so far are given out,
    which is right at any time as they are summed again.
    """
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        rows = []
        for r, (occurrences, records) in held.items():
            at = np.flatnonzero(occurrences)
            rows.append((r, at.astype(np.int32), occurrences[at], records[at]))
        held.clear()
        return pa.record_batch([
            pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.list_(pa.int32())),
            pa.array([x[2] for x in rows], pa.list_(pa.int64())), pa.array([x[3] for x in rows], pa.list_(pa.int64())),
        ], names=["range", "at", "occurrences", "records"])

    for batch in batches:
        ids, n, present = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        parts = ids // RANGE
        for r in np.unique(parts):
            if r not in held and len(held) >= HELD:
                yield out()
            occurrences, records = held.setdefault(int(r), (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)))
            mine = parts == r
            occurrences += np.bincount(ids[mine] - r * RANGE, n[mine], RANGE).astype(np.int64)
            records += np.bincount(ids[mine] - r * RANGE, present[mine], RANGE).astype(np.int64)
    if held:
        yield out()


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the arrays of each range; they come sorted by range."""
    now, sums = None, np.zeros((2, RANGE), np.int64)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(sums[0])
        return pa.record_batch([pa.array(at + now * RANGE), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["id", "n_occurrences", "n_records"])

    for batch in batches:
        for k, r in enumerate(batch.column(0).to_pylist()):
            if r != now:
                if now is not None:
                    yield out()
                now = r
                sums[:] = 0
            at = batch.column(1)[k].values.to_numpy()
            sums[0, at] += batch.column(2)[k].values.to_numpy()
            sums[1, at] += batch.column(3)[k].values.to_numpy()
    if now is not None:
        yield out()


def term_frequencies(df: DataFrame, term: str, record: str, share: float | None = None) -> DataFrame:
    """``(term, n_occurrences, n_records)`` for every distinct non-blank ``term``.

    ``n_occurrences`` counts rows, repeated ones again; ``n_records`` counts
    different non-blank values of ``record`` and may be 0. Values are compared as
    stored. Blank terms are left out; an empty table gives no rows; other columns
    are ignored.

    The dictionary numbers all terms. Rows of ordinary terms meet it in one
    shuffle by term, in which they are also reduced to one per record; rows of
    the few terms that a sketch finds heavy (``share`` of all rows, by default a
    quarter of what a shuffle partition holds, ``fair_share``) meet a broadcast of at most
    ``2 / share`` dictionary rows and are reduced over (term, record). The encoded
    rows become count arrays block by block, and these are summed by range.
    """
    rows = df.where(not_blank(term)).select(F.col(term).alias("t"), F.when(not_blank(record), F.col(record)).alias("r"))
    dictionary = number_rows(rows.groupBy("t").agg(F.count(F.lit(1)).alias("_n")).select("t"))
    values, _ = key_candidates(rows, F.col("t"), share or fair_share(df.sparkSession))
    names = F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], "t string"))
    light, heavy = rows.join(names, "t", "left_anti"), rows.join(names, "t", "left_semi")
    some = F.broadcast(dictionary.join(names, "t", "left_semi"))
    count = F.count(F.lit(1)).alias("n")
    parts = [light.join(dictionary.hint("merge"), "t").groupBy("t", "id", "r").agg(count)]
    if values:
        parts.append(heavy.groupBy("t", "r").agg(count).join(some, "t"))
    encoded = [p.select("id", "n", F.when(F.col("r").isNotNull(), 1).otherwise(0).cast("bigint").alias("in_record")) for p in parts]
    blocks = encoded[0].unionByName(encoded[1]) if values else encoded[0]
    arrays = blocks.mapInArrow(_count_blocks, _PARTIAL)
    sums = arrays.repartition("range").sortWithinPartitions("range").mapInArrow(_sum_ranges, "id bigint, n_occurrences bigint, n_records bigint")
    return sums.join(dictionary, "id").select(F.col("t").alias(term), "n_occurrences", "n_records")


def marked_terms(df: DataFrame, term: str, record: str, rare: int = 3, common: float = 1 / 50, share: float | None = None) -> DataFrame:
    """``term_frequencies`` with ``mark``: ``rare`` under ``rare`` records, ``common``
    over a ``common`` share of all different non-blank records, else null."""
    total = df.where(not_blank(record)).agg(F.countDistinct(record)).first()[0]
    mark = F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") * round(1 / common) > total, "common")
    return term_frequencies(df, term, record, share).withColumn("mark", mark)
