"""Items that appear together: a blocked Gram matrix of sparse baskets."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from arcweave.operators.dictionary import number_rows
from arcweave.operators.skew import not_blank, split_join
from arcweave.session import materialize

if TYPE_CHECKING:
    from collections.abc import Callable, Iterator

    from pyspark.sql import DataFrame

DENSE = 256        # the most frequent items form one dense block; a multiple of WIDTH
WIDTH = 256        # items of every other block
LARGE = 1024       # items of a basket that is cut into slices
SLICE = 256        # items of such a slice
BLOCK = 200_000    # incidences of a record block
PAIRS = 4_000_000  # sparse products held before they are summed
HELD = 8_000_000   # different pairs of one block held before their sums are given out
LOAD = 1_000_000   # rows of an item block that one task takes
SMALL = 200_000    # items of a dictionary that is broadcast
_PAIR = "i bigint, j bigint, n bigint"


def _sums(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(n)], names=["i", "j", "n"])


def _dense(size: int) -> Callable:
    """Matrix products of binary record blocks over the ``size`` most frequent items; sums (i, j, n), i < j, at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), np.int64)
        for batch in batches:
            for begin in range(0, len(batch), max(1, BLOCK // size)):
                items = batch.column(0).slice(begin, max(1, BLOCK // size))
                flat = items.flatten().to_numpy()
                row = np.repeat(np.arange(len(items)), pc.list_value_length(items).to_numpy())
                binary = np.zeros((len(items), size), np.float32)
                binary[row, flat] = 1
                total += (binary.T @ binary).astype(np.int64)
        i, j = np.nonzero(np.triu(total, 1))
        if len(i):
            yield _sums((i << 32) | j, total[i, j])

    return run


class _Sum:
    """Sums of pair codes, compacted as they grow."""

    def __init__(self):
        self.codes, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i.astype(np.int64) << 32) | j)
        self.size += len(i)
        if self.size > PAIRS:
            self.compact()

    def compact(self) -> None:
        if self.held:
            new, n = np.unique(np.concatenate(self.held), return_counts=True)
            codes, at = np.unique(np.concatenate([self.codes, new]), return_inverse=True)
            self.n = np.bincount(at, np.concatenate([self.n, n]), len(codes)).astype(np.int64)
            self.codes, self.held, self.size = codes, [], 0

    def out(self, least: int) -> Iterator[pa.RecordBatch]:
        self.compact()
        keep = self.n >= least
        if keep.any():
            yield _sums(self.codes[keep], self.n[keep])
        self.codes, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _blocks(width: int, min_pair: int) -> Callable:
    """Rows (block, salts, ids) sorted by block to (i, j, n) of all pairs whose j is in the block.

    ``ids`` are a basket's items up to its last one in the block, in order. Sums of a
    block that one task holds whole are complete, so those under ``min_pair`` end here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, total = None, True, _Sum()
        for batch in batches:
            blocks, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if blocks[lo] != now:
                    yield from total.out(min_pair if whole else 1)
                    now, whole = blocks[lo], salts[lo] == 1
                items = batch.column(2).slice(lo, hi - lo)
                flat, size = items.flatten().to_numpy(), pc.list_value_length(items).to_numpy()
                row, step = np.repeat(np.arange(len(size)), size), 1
                own = flat >= now * width
                while step < len(flat):
                    near = own[step:] & (row[step:] == row[:-step])
                    if not near.any() and step >= size.max():
                        break
                    total.add(flat[:-step][near], flat[step:][near])
                    if len(total.codes) > HELD:
                        yield from total.out(1)
                        whole = False
                    step += 1
        yield from total.out(min_pair if whole else 1)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of two slices of a large basket, (left, right), to (i, j, n), i < j."""
    total = _Sum()
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            a, b = left.values.to_numpy(), right.values.to_numpy()
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
            total.add(i[i < j], j[i < j])
            if len(total.codes) > HELD:
                yield from total.out(1)
    yield from total.out(1)


def latest_baskets(pages: DataFrame, record: str, items: str, at: str) -> DataFrame:
    """``(record, items)``: the row with the latest ``at`` of each record, distinct non-blank items.

    Rows without a record id are left out; a null time is the earliest; of rows
    tied in time the one with the greatest list counts; records left without
    items come out in no row.
    """
    last = pages.where(F.col(record).isNotNull()).groupBy(F.col(record).alias("record")).agg(
        F.max(F.struct(F.col(at).alias("t"), F.col(items).alias("items"))).alias("x")
    )
    kept = F.array_distinct(F.filter(F.coalesce("x.items", F.array().cast("array<string>")), lambda x: not_blank(x)))
    return last.select("record", kept.alias("items")).where(F.size("items") > 0)


def cooccurrence(baskets: DataFrame, min_pair: int = 5, min_lift: float = 4.0) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n, lift)`` of pairs in the same basket.

    ``baskets`` has ``record`` (unique) and ``items`` (distinct strings). Pairs
    have ``item_a < item_b`` by code point, ``n_ab >= min_pair`` baskets in common
    and ``lift = n_ab * n / (n_a * n_b) >= min_lift``. No baskets, no rows.

    An item in fewer than ``min_pair`` baskets, or in more than ``n / min_lift``,
    is in no such pair (n_ab is at most the smaller count), so only the others are
    numbered, by falling frequency, and the baskets written once as sorted numbers.

    The Gram matrix of the DENSE most frequent items is a sum of matrix products. All
    other pairs belong to the block of their rarer item j: each basket sends the items
    up to j to that block, whose sums so are complete before anything is shuffled
    again. As the numbers follow frequency, block b holds at most 1/b of all
    incidences, and is spread over salts by this bound. Baskets over LARGE items are
    cut into pairs of slices instead, so none is one task's work.
    """
    baskets = materialize(baskets.select("record", "items"))
    n = baskets.count()
    rows = baskets.select("record", F.explode("items").alias("item"))
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    useful = counts.where((F.col("m") >= min_pair) & (F.col("m") * F.lit(float(min_lift)) <= n))
    dictionary = number_rows(useful.orderBy(F.desc("m"), "item"))
    known = dictionary.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("m"), F.lit(0)).alias("incidences")).first()
    small = known["items"] <= SMALL
    names = dictionary.select("item", "id")
    met = rows.join(F.broadcast(names), "item") if small else split_join(rows, names, "item")
    ids = F.array_sort(F.collect_list("id")).alias("ids")
    coded = materialize(met.groupBy("record").agg(ids).where(F.size("ids") > 1))
    usual, large = coded.where(F.size("ids") <= LARGE), coded.where(F.size("ids") > LARGE).select("ids")

    dense = usual.where(F.col("ids")[1] < DENSE).select(F.filter("ids", lambda x: x < DENSE).alias("ids")).mapInArrow(_dense(DENSE), _PAIR)
    block = F.floor(F.col("id") / WIDTH)
    last = usual.select("record", "ids", F.posexplode("ids").alias("pos", "id")).where(
        (F.col("id") >= DENSE) & (F.col("pos") > 0) & ((F.col("pos") == F.size("ids") - 1) | (F.floor(F.get("ids", F.col("pos") + 1) / WIDTH) > block))
    )
    salts = F.ceil(F.lit(float(known["incidences"])) / (F.greatest(block, F.lit(1)) * LOAD))
    rows_of = last.select(block.alias("b"), salts.alias("salts"), F.pmod(F.xxhash64("record"), salts).alias("salt"), F.slice("ids", F.lit(1), F.col("pos") + 1).alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(SLICE))
    cut = large.select("ids", F.explode(starts).alias("a")).select("ids", "a", F.explode(F.filter(starts, lambda b: b >= F.col("a"))).alias("b"))
    cut = cut.select(F.slice("ids", F.col("a"), F.lit(SLICE)).alias("left"), F.slice("ids", F.col("b"), F.lit(SLICE)).alias("right"))
    slices = cut.repartition("left", "right").mapInArrow(_slices, _PAIR)

    # Slices of large baskets add to the sums of blocks, which may end early only where there are no such baskets.
    many = large.limit(1).count() > 0
    sparse = rows_of.repartition("b", "salt").select("b", "salts", "ids").sortWithinPartitions("b").mapInArrow(_blocks(WIDTH, 1 if many else min_pair), _PAIR)
    partial = dense.unionByName(sparse)
    partial = partial.unionByName(slices) if many else partial
    pairs = partial.groupBy("i", "j").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_pair)
    side = F.broadcast if small else (lambda d: d)
    a = side(dictionary.select(F.col("id").alias("i"), F.col("item").alias("x"), F.col("m").alias("nx")))
    b = side(dictionary.select(F.col("id").alias("j"), F.col("item").alias("y"), F.col("m").alias("ny")))
    met = pairs.join(a, "i").join(b, "j").where(F.col("n_ab") * F.lit(float(n)) >= F.lit(float(min_lift)) * F.col("nx") * F.col("ny"))
    swap = F.col("x") > F.col("y")
    return met.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("item_a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("item_b"),
        "n_ab", F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("n_a"), F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("n_b"),
        F.lit(n).cast("bigint").alias("n"), (F.col("n_ab") * F.lit(float(n)) / (F.col("nx") * F.col("ny"))).alias("lift"),
    )
