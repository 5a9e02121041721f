"""Duplicates hidden by formatting: skip-and-fold hashing of raw bytes.

Two records are the same when their two ends have the same letters and digits in
the same order, letter case ignored and everything else skipped. The ends are
never rewritten as canonical strings: their bytes run through a table that maps
each to its folded code (0: skipped) straight into a polynomial hash, and rows
that meet in one hash are compared by two pointers that skip alike.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.llm.codes import BASE, Table, byte_codes, chunks, mixed, powers, text_bytes
from arcweave.operators.skew import fair_share, key_candidates
from arcweave.session import materialize

if TYPE_CHECKING:
    from collections.abc import Iterator

    from pyspark.sql import DataFrame

# Code of each letter and digit, case folded; 0: skipped.
fold_codes = Table(lambda ch: ch.isalpha() or ch.isdecimal())
STEP = 1 << 20   # bytes hashed, or compared, at once


def _cuts(data: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Pieces of about ``step`` bytes that cut no letter apart."""
    begin = 0
    while begin < len(data):
        end = min(begin + step, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[begin:end]
        begin = end


def _hash(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    folded = byte_codes(data, fold_codes)
    seen = np.concatenate([[0], np.cumsum(folded != 0)])
    n = np.diff(seen[offsets])
    place = seen[:-1] - np.repeat(seen[offsets[:-1]], np.diff(offsets))
    value = np.where(folded != 0, mixed(folded) * powers(BASE, int(n.max(initial=0)) + 1)[place], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]], n


def fold_hash(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of the letters and digits of each value, and their number.

    The bytes stream through the table in pieces of about STEP, long values too,
    so memory does not grow with the length of a value.
    """
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, part in chunks(column, STEP):
        data, offsets = text_bytes(part)
        if len(part) > 1 or len(data) <= STEP:
            h, n = _hash(data, offsets)
        else:
            value = count = 0
            for piece in _cuts(data, STEP):
                h, n = _hash(piece, np.array([0, len(piece)]))
                value = (value + int(h[0]) * pow(int(BASE), count, 1 << 64)) % (1 << 64)
                count += int(n[0])
            h, n = np.array([value], np.uint64), np.array([count])
        hashes.append(h)
        sizes.append(n)
    return np.concatenate(hashes).view(np.int64), np.concatenate(sizes)


def _same_long(a: np.ndarray, b: np.ndarray) -> bool:
    """Two pointers over two long values, a piece at a time: each skips on its own, what both have reached is compared."""
    left, right = _cuts(a, STEP), _cuts(b, STEP)
    x = y = np.zeros(0, np.uint32)
    i = j = np.zeros(0, np.int64)  # places in the piece that are kept and not compared yet
    while True:
        while not len(i) and (piece := next(left, None)) is not None:
            x = byte_codes(piece, fold_codes)
            i = np.flatnonzero(x)
        while not len(j) and (piece := next(right, None)) is not None:
            y = byte_codes(piece, fold_codes)
            j = np.flatnonzero(y)
        n = min(len(i), len(j))
        if not n:
            return len(i) == len(j)
        if (x[i[:n]] != y[j[:n]]).any():
            return False
        i, j = i[n:], j[n:]


def same_folded(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether each two values agree, by two pointers that skip and fold.

    The pointers of all pairs advance together, each on its own; a pair drops out
    at its first difference or when both values are used up. Equal bytes need none.
    """
    same = pc.fill_null(pc.equal(left, right), False).to_numpy(zero_copy_only=False).copy()
    ask = np.flatnonzero(~same)
    if not len(ask):
        return same
    (a, oa), (b, ob) = text_bytes(left.take(pa.array(ask))), text_bytes(right.take(pa.array(ask)))
    long = np.maximum(np.diff(oa), np.diff(ob)) > 1000
    for k in np.flatnonzero(long):
        same[ask[k]] = _same_long(a[oa[k] : oa[k + 1]], b[ob[k] : ob[k + 1]])
    a, b = np.append(byte_codes(a, fold_codes), np.uint32(0)), np.append(byte_codes(b, fold_codes), np.uint32(0))

    def following(folded: np.ndarray) -> np.ndarray:
        """Place of the first kept code at or after each place."""
        at = np.where(folded != 0, np.arange(len(folded)), len(folded) - 1)
        return np.minimum.accumulate(at[::-1])[::-1]

    na, nb = following(a), following(b)
    live = np.flatnonzero(~long)
    same[ask[live]] = True
    i, j, ei, ej = oa[:-1].copy(), ob[:-1].copy(), oa[1:], ob[1:]
    while len(live):
        i[live], j[live] = na[np.minimum(i[live], len(a) - 1)], nb[np.minimum(j[live], len(b) - 1)]
        more_a, more_b = i[live] < ei[live], j[live] < ej[live]
        ok = (more_a == more_b) & (~more_a | (a[np.minimum(i[live], len(a) - 1)] == b[np.minimum(j[live], len(b) - 1)]))
        same[ask[live[~ok]]] = False
        live = live[ok & more_a]
        i[live] += 1
        j[live] += 1
    return same


@F.arrow_udf(T.StructType([T.StructField("hs", T.LongType()), T.StructField("hd", T.LongType())]))
def _ends_hash(src: pa.Array, dst: pa.Array) -> pa.Array:
    (hs, ns), (hd, nd) = fold_hash(src), fold_hash(dst)
    return pa.StructArray.from_arrays([pa.array(hs), pa.array(hd)], ["hs", "hd"], mask=pa.array((ns == 0) | (nd == 0)))


@F.arrow_udf(T.BooleanType())
def _ends_same(s1: pa.Array, s2: pa.Array, d1: pa.Array, d2: pa.Array) -> pa.Array:
    return pa.array(same_folded(s1, s2) & same_folded(d1, d2))


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """Row of the first record of its group for each row; rows are sorted by hashes and id."""
    hs, hd = (batch.column(i).to_numpy() for i in range(2))
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (hd[1:] != hd[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(hs)), 0))
    later = np.flatnonzero(~new)
    ends = batch.column(3), batch.column(4)
    ok = np.ones(len(later), bool)
    for end in ends:
        ok &= same_folded(end.take(pa.array(later)), end.take(pa.array(first[later])))
    run_of = first.copy()
    for run in np.unique(first[later[~ok]]):  # two different records in one hash: each row with the heads so far
        heads: list[int] = []
        for k in np.flatnonzero(run_of == run):
            head = next((h for h in heads if all(same_folded(e.slice(h, 1), e.slice(k, 1))[0] for e in ends)), None)
            if head is None:
                heads.append(head := k)
            first[k] = head
    return first


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First record of its group for each row of a stream sorted by hashes and id.

    Between batches only the heads of the last run are kept (one row for each
    different record in one hash), so a group of any size streams through.
    """
    kinds = pa.schema([(n, t) for n, t in zip(("hs", "hd", "edge_id", "src", "dst"), (pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.large_string()))])
    heads: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.record_batch([c.cast(f.type) for c, f in zip(batch.columns, kinds)], schema=kinds)
        carried = 0
        if heads is not None and (heads.column(0)[0], heads.column(1)[0]) == (rows.column(0)[0], rows.column(1)[0]):
            carried = len(heads)
            rows = pa.record_batch([pa.concat_arrays([h, c]) for h, c in zip(heads.columns, rows.columns)], schema=kinds)
        first = _groups(rows)
        ids = rows.column(2).to_numpy()
        yield pa.record_batch([pa.array(ids[first][carried:]), pa.array(ids[carried:])], names=["first_edge_id", "edge_id"])
        hs, hd = (rows.column(i).to_numpy() for i in range(2))
        heads = rows.take(pa.array(np.unique(first[(hs == hs[-1]) & (hd == hd[-1])])))


def link_groups(links: DataFrame, share: float | None = None) -> DataFrame:
    """``(first_edge_id, edge_id)`` for every link: the smallest id of its group.

    ``links`` has ``edge_id`` (unique), ``src`` and ``dst``; other columns are
    ignored. A link without a letter or digit at one end, null ends and ids included,
    comes out in no row; a link without a copy is its own first. Direction
    counts, letter case does not, accents do. Texts of any length are read whole.

    Every end is hashed once, into a table in the shared folder. A group that may
    hold over ``share`` of all links (default: a part of what a shuffle partition
    holds, ``fair_share``) never enters a shuffle by hash: a sketch of the hashes
    finds it, and its rows are compared with its first link after a broadcast of
    at most ``2 / share`` rows. All other groups are sorted runs of one shuffle that
    stream past their first row; what differs from the first link of a heavy hash
    (hardly ever anything) joins them there.
    """
    share = share or fair_share(links.sparkSession, 1000)
    hashed = materialize(
        links.where("edge_id is not null").select("edge_id", "src", "dst").withColumn("h", _ends_hash("src", "dst"))
        .where(F.col("h").isNotNull())
        .select(F.col("h.hs").alias("hs"), F.col("h.hd").alias("hd"), "edge_id", "src", "dst")
    )
    key = F.xxhash64("hs", "hd")
    values, _ = key_candidates(hashed, key, share)
    light, exact = hashed, None
    if values:
        light, heavy = hashed.where(~key.isin(values)), hashed.where(key.isin(values))
        ids = [r["f"] for r in heavy.groupBy("hs", "hd").agg(F.min("edge_id").alias("f")).collect()]
        firsts = hashed.where(F.col("edge_id").isin(ids)).select("hs", "hd", F.col("edge_id").alias("first_edge_id"), F.col("src").alias("s1"), F.col("dst").alias("d1"))
        met = heavy.join(F.broadcast(firsts), ["hs", "hd"]).withColumn("same", _ends_same("src", "s1", "dst", "d1"))
        exact = met.where("same").select("first_edge_id", "edge_id")
        light = light.unionByName(met.where("not same").select(*hashed.columns))
    runs = light.repartition("hs", "hd").sortWithinPartitions("hs", "hd", "edge_id")
    out = runs.mapInArrow(_scan_runs, "first_edge_id bigint, edge_id bigint")
    return out if exact is None else exact.unionByName(out)


def distinct_links(links: DataFrame, share: float | None = None) -> DataFrame:
    """``(edge_id, src, dst, n_copies)``: the first link of each group as stored, and the size of its group."""
    sizes = link_groups(links, share).groupBy(F.col("first_edge_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("n_copies"))
    return links.select("edge_id", "src", "dst").join(sizes, "edge_id")
