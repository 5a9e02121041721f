"""Mixing sources to target weights under a repetition limit, sized in tokens."""

from __future__ import annotations

import base64
import functools
import math
import os
from collections.abc import Iterator  # noqa: TC003  read at run time by arrow_udf
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.session import materialize

if TYPE_CHECKING:
    from collections.abc import Callable

    from pyspark.sql import Column, DataFrame

#: Vocabulary file where no other is named; ``ARCWEAVE_VOCABULARY`` sets another one.
VOCABULARY = os.environ.get("ARCWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how byte-level BPE vocabularies of this kind cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PARTS = 1 << 16        # pieces of a source's permutation
BLOCK_TOKENS = 1 << 20  # tokens of a training block


@functools.lru_cache(maxsize=2)
def _encoding(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)``; whole texts, 0 for null and empty ones.

    ``vocabulary`` is a file of base64 tokens and ranks that only the driver
    reads; its content (under 1 MB) goes out with the task.
    """
    shared = documents.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    @F.arrow_udf(T.LongType())
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoding(shared.value).encode_ordinary
        for column in texts:
            yield pa.array([len(encode(t)) if t else 0 for t in column.to_pylist()], pa.int64())

    return documents.select("doc_id", "source", count("text").alias("n_tokens"))


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to ``exponent`` and normalised; 1 keeps them, 0 levels them."""
    top = max(shares.values(), default=1.0)
    raised = {k: (v / top) ** exponent for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in shares.values() if v > 0)


def _bisect(ok, lo: float, hi: float) -> float:
    """The largest value up to ``hi`` that is ``ok``, given that ``lo`` is and that what is below an ok value is too."""
    if ok(hi):
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def exponent_for_entropy(shares: dict[str, float], least: float) -> float:
    """The largest exponent in [0, 1] at which the tempered shares have an entropy of ``least`` or more."""
    return _bisect(lambda x: entropy(tempered(shares, x)) >= least, 0.0, 1.0)


def exponent_for_limits(shares: dict[str, float], room: dict[str, float], total: float) -> float:
    """The smallest exponent in [0, 1] at which ``total`` times no tempered share passes its source's ``room``.

    Smaller exponents level the shares, so small sources are repeated more. Where even
    the shares themselves (1) do not fit, 1.
    """
    fits = lambda x: all(w * total <= room[s] * (1 + 1e-12) for s, w in tempered(shares, x).items())
    return 1.0 - _bisect(lambda y: fits(1.0 - y), 0.0, 1.0) if fits(1.0) else 1.0


def _live(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int]) -> list[str]:
    return [s for s, t in targets.items() if t and t > 0 and tokens.get(s, 0) > 0 and (repeats[s] or 0) > 0]


def plan_mix(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Token budget of each source.

    Sources without tokens, a positive target or a positive limit get none; the
    other targets are scaled to sum 1. Without ``total`` the mix is the largest in
    which every target is met exactly within the limits. With a larger ``total``
    the ratio of target to natural share is exponentiated, and the exponent is
    bisected to the largest at which no source passes its limit: from the targets
    (1) toward the natural shares (0), where every source is repeated alike. If
    even those exceed a limit, the total is cut to what they allow.
    """
    live = _live(tokens, targets, repeats)
    if not live:
        return {}
    room = {s: tokens[s] * repeats[s] for s in live}
    goal, natural = tempered({s: targets[s] for s in live}, 1), tempered({s: float(tokens[s]) for s in live}, 1)
    if total is None:
        total = min(room[s] / goal[s] for s in live)

    def weights(x: float) -> dict[str, float]:
        return tempered({s: natural[s] * (goal[s] / natural[s]) ** x for s in live}, 1)

    total = min(total, max(min(room[s] / w for s, w in weights(x).items()) for x in (0.0, 1.0)))
    fits = lambda x: all(w * total <= room[s] * (1 + 1e-12) for s, w in weights(x).items())
    x = _bisect(fits, 0.0, 1.0)
    return {s: min(w * total, float(room[s])) for s, w in weights(x).items()}


def plan_temperature(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Token budget of each source when the natural shares are tempered by one exponent.

    The shares of the live sources are raised to the largest exponent at which their
    entropy reaches that of the targets, or, if that would repeat a source beyond its
    limit, to the smallest that keeps all limits; both are bisected. ``total`` is as
    many tokens as the live sources have, unless it is given; it is cut to what the
    natural shares allow.
    """
    live = _live(tokens, targets, repeats)
    if not live:
        return {}
    room, natural = {s: float(tokens[s] * repeats[s]) for s in live}, tempered({s: float(tokens[s]) for s in live}, 1)
    total = min(total or float(sum(tokens[s] for s in live)), min(room[s] / w for s, w in natural.items()))
    least = entropy(tempered({s: targets[s] for s in live}, 1))
    x = max(exponent_for_entropy(natural, least), exponent_for_limits(natural, room, total))
    return {s: min(w * total, room[s]) for s, w in tempered(natural, x).items()}


def _goals(targets: DataFrame) -> DataFrame:
    """One row a source: the greatest of its shares and of its limits."""
    return targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _blocks_of(copies: DataFrame, order: Column, size: int) -> DataFrame:
    """Add ``block`` and ``place``: the uses in random order, cut into blocks of ``size`` tokens; a use is in the block it begins in."""
    kinds = {"doc_id": pa.int64(), "source": pa.string(), "n_tokens": pa.int64(), "copy": pa.int32(), "_p": pa.int32(), "_t": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.record_batch([*batch.columns[:4], pa.array(np.full(len(n), part, np.int32)), pa.array(before)], names=list(kinds))

    ordered = copies.select("doc_id", "source", "n_tokens", "copy", order.alias("_o")).orderBy("_o", "doc_id", "copy").drop("_o")
    placed = materialize(ordered.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, copy int, _p int, _t bigint"))
    starts, total = [], 0
    for r in placed.groupBy("_p").agg(F.sum("n_tokens").alias("n")).orderBy("_p").collect():
        starts.append((r["_p"], total))
        total += r["n"]
    at = F.col("_t") + F.col("_s")
    return placed.join(F.broadcast(copies.sparkSession.createDataFrame(starts, "_p int, _s bigint")), "_p").select(
        "doc_id", "source", "n_tokens", "copy", F.floor(at / size).alias("block"), F.pmod(at, F.lit(size)).alias("place")
    )


def mix(
    counted: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, plan: Callable = plan_mix, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``(doc_id, source, n_tokens, copy, block, place)``: one row per use of a document.

    ``counted`` is the result of ``count_tokens`` (use ``materialize`` on it: it is
    read several times). Each source's documents are permuted by hash. All of them
    are used as often as the budget covers the whole source, and then the pieces of
    the permutation from its start, up to the budget; in the last piece document by
    document. No document is used more than ``max_repeats`` times. The uses of all
    sources are then permuted together and cut into training blocks of
    ``block_tokens``; ``place`` is the token of its block at which a use begins.
    ``plan`` gives the budgets: ``plan_mix`` meets the targets, ``plan_temperature``
    tempers the natural shares.

    Documents without tokens, with a null source or one that has no target are
    left out; of several targets of one source the greatest counts; empty tables
    give no rows. Of each source only its sums come to the driver.
    """
    spark = counted.sparkSession
    goals = _goals(targets)
    rows = counted.where("n_tokens > 0 and source is not null").select("doc_id", "source", "n_tokens").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.withColumn("_b", F.shiftrightunsigned("_h", 64 - int(math.log2(_PARTS))).cast("int"))
    pieces = materialize(rows.groupBy("source", "_b").agg(F.sum("n_tokens").alias("t")))
    sums = pieces.groupBy("source").agg(F.sum("t").alias("tokens")).join(goals, "source").collect()
    tokens = {r["source"]: r["tokens"] for r in sums}
    repeats = {r["source"]: r["max_repeats"] or 0 for r in sums}
    budget = plan(tokens, {r["source"]: r["target_share"] for r in sums}, repeats, total)
    whole = {s: min(int(size / tokens[s] + 1e-9), repeats[s]) for s, size in budget.items()}
    budgets = [(s, whole[s], int(round(size - whole[s] * tokens[s])) if whole[s] < repeats[s] else 0) for s, size in budget.items()]
    plans = F.broadcast(spark.createDataFrame(budgets, "source string, _whole int, _left bigint"))
    # The first piece that the rest of the budget does not cover; pieces before it are used whole.
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("_b"))
    cut = pieces.withColumn("_u", upto).join(plans, "source").where("_u > _left").groupBy("source").agg(F.min_by(F.struct("_b", (F.col("_left") - F.col("_u") + F.col("t")).alias("l")), "_b").alias("c"))
    cut = F.broadcast(cut.select("source", F.col("c._b").alias("_cut"), F.col("c.l").alias("_rest")))
    rows = rows.join(plans, "source").join(cut, "source", "left")
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("_h", "doc_id"))
    sure = rows.where("_cut is null or _b <> _cut").withColumn("_more", F.coalesce(F.col("_b") < F.col("_cut"), F.col("_left") > 0))
    edge = rows.where("_b = _cut").withColumn("_more", running <= F.col("_rest"))
    used = sure.unionByName(edge).withColumn("_n", F.col("_whole") + F.col("_more").cast("int")).where("_n > 0")
    copies = used.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    return _blocks_of(copies, F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), block_tokens)


def mix_report(counted: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and reached share of every source of ``targets``, with what it has and gives.

    ``(source, target_share, max_repeats, available_tokens, mixed_tokens, share,
    most_copies)``; a source without documents reports zeros.
    """
    have = counted.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    gave = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("copy").alias("most_copies"))
    rows = _goals(targets).join(have, "source", "left").join(gave, "source", "left").na.fill(0)
    sums = gave.agg(F.sum("mixed_tokens").alias("_all")).withColumn("_k", F.lit(0))
    share = F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("_all")), F.lit(0.0))
    return rows.withColumn("_k", F.lit(0)).join(F.broadcast(sums), "_k").select(*rows.columns, share.alias("share"))


def mix_checks(counted: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row of counts that are 0 for a right ``plan_mix`` mix without ``total``.

    ``over_limit``: documents used more than ``max_repeats`` times or twice under one
    copy; ``off_target``: sources whose tokens are further from their part of the
    largest exact mix than one document of the source; ``unplaced``: pairs of uses
    in one block that begin at one token.
    """
    per = counted.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("most"))
    live = _goals(targets).join(per, "source").where("target_share > 0 and max_repeats > 0")
    share = live.agg(F.sum("target_share").alias("all"), F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("unit")).withColumn("_k", F.lit(0))
    gave = mixed.groupBy("source").agg(F.sum("n_tokens").alias("got"))
    goal = live.withColumn("_k", F.lit(0)).join(F.broadcast(share), "_k").join(gave, "source", "left")
    off = goal.where(F.abs(F.coalesce("got", F.lit(0)) - F.col("target_share") * F.col("unit")) > F.col("most") + 1)
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("d"))
    over = uses.join(F.broadcast(_goals(targets)), "source").where("n > max_repeats or n <> d")
    twice = mixed.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = [d.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(0)) for d, name in ((over, "over_limit"), (off, "off_target"), (twice, "unplaced"))]
    return counts[0].join(counts[1], "_k").join(counts[2], "_k").drop("_k")


def counted_once(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``count_tokens`` written once to the shared folder."""
    return materialize(count_tokens(documents, vocabulary))
