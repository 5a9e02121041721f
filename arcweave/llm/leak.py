"""Evaluation texts leaking into documents: suffix arrays over document shards.

Every shard of documents gets a suffix array over its words. Every suffix of every
test item is looked up in it by binary search, which gives all verbatim matches
and their places; each match is extended to its longest. Counting an item's words
says which stretches could hold enough of them; these are compared word by word,
the one at the longest match first, as far as they could still hold more.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from arcweave.llm.codes import chunks, word_hashes

if TYPE_CHECKING:
    from collections.abc import Callable, Iterator

    from pyspark.sql import DataFrame

SHARD = 2_500_000        # bytes of a shard
ITEM_BLOCK = 8_000_000   # characters of test items sent out at once
HITS = 4_000_000         # places of item words counted in one pass


def in_runs(tokens: np.ndarray, shortest: int) -> np.ndarray:
    """The tokens, with 0 for those outside runs of ``shortest`` non-zero ones: no match of that length has them."""
    known = np.concatenate([tokens > 0, np.zeros(shortest, bool)])
    begins = np.logical_and.reduce([known[k : k + len(tokens)] for k in range(shortest)])
    padded = np.concatenate([np.zeros(shortest - 1, bool), begins])
    return np.where(np.logical_or.reduce([padded[k : k + len(tokens)] for k in range(shortest)]), tokens, 0)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of all non-zero tokens, sorted by the ``depth`` tokens that begin there.

    Prefix doubling; token 0 stands for a word that no item has, or the end of a
    document, and sorts first.
    """
    places = np.flatnonzero(tokens)
    rank = np.zeros(len(tokens) + depth + 1, np.int64)
    rank[: len(tokens)] = tokens
    step, known = 1, -1
    order = np.argsort(rank[places])
    while step < depth and len(places):
        key = rank[places] * (len(tokens) + int(tokens.max()) + 1) + rank[places + step]
        order = np.argsort(key)
        new = np.concatenate([[1], np.diff(key[order]) != 0]).cumsum()
        rank[places[order]] = new
        if new[-1] == known:
            break
        known = new[-1]
        step *= 2
    return places[order]


class Items:
    """Test items as integer words, end to end with zeros between."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes, at = word_hashes(pa.array([t for _, t in rows], pa.string()))
        size = np.diff(at)
        self.vocabulary, code = np.unique(hashes, return_inverse=True)
        self.ids, self.size = np.array([i for i, _ in rows], np.int64)[size > 0], size[size > 0]
        self.start = np.concatenate([[1], 1 + np.cumsum(self.size + 1)])[: len(self.ids)].astype(np.int64)
        self.words = np.zeros(int((self.size + 1).sum()) + 1, np.int32)
        self.words[np.repeat(self.start - np.concatenate([[0], np.cumsum(self.size)[:-1]]), self.size) + np.arange(int(self.size.sum()))] = code + 1
        self.owner = np.repeat(np.arange(len(self.ids)), self.size + 1)
        self.owner = np.concatenate([[-1], self.owner])
        self.depth = int(self.size.max(initial=1))
        self.masks: tuple[int, dict[int, int]] = (-1, {})  # of the item compared last

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Integer words of all texts, 0 after each text and for words no item has; offsets."""
        hashes, at = word_hashes(texts)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[place] == hashes, place + 1, 0)
        return np.insert(code, at[1:], 0).astype(np.int32), at + np.arange(len(at))

    def matches(self, tokens: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item place, token place, length) of all left-maximal verbatim matches."""
        order = suffix_array(tokens := in_runs(tokens, shortest), self.depth)
        far = np.concatenate([tokens, np.zeros(self.depth + 1, tokens.dtype)])
        item = np.flatnonzero(self.words)
        lo, hi = np.zeros(len(item), np.int64), np.full(len(item), len(order))
        for d in range(shortest):
            want = self.words[np.minimum(item + d, len(self.words) - 1)]
            lo, hi = self._bound(far, order, lo, hi, want, d, False), self._bound(far, order, lo, hi, want, d, True)
            keep = (lo < hi) & (want > 0)
            item, lo, hi = item[keep], lo[keep], hi[keep]
        n = hi - lo
        a = np.repeat(item, n)
        p = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))] if len(n) else np.zeros(0, np.int64)
        before = np.where(p > 0, tokens[np.maximum(p - 1, 0)], 0) if len(tokens) else p
        first = (self.words[a - 1] != before) | (before == 0)
        a, p = a[first], p[first]
        length = np.full(len(a), shortest)
        live = np.arange(len(a))
        while len(live):
            x = self.words[np.minimum(a[live] + length[live], len(self.words) - 1)]
            live = live[(x == far[p[live] + length[live]]) & (x > 0)]
            length[live] += 1
        return a, p, length

    @staticmethod
    def _bound(far, order, lo, hi, want, d, after):
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            got = far[order[np.minimum(mid, len(order) - 1)] + d]
            right = open_ & ((got <= want) if after else (got < want))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    def stretches(self, tokens: np.ndarray, ends: np.ndarray, need: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, token place, words) of every stretch that begins with an item word and holds ``need`` words of the item or more.

        No stretch is missed: of ``need`` words, all but those left out are among an
        item's rarest words, so only stretches that hold as many of these are counted.
        """
        places = np.argsort(tokens, kind="stable")
        codes = len(self.vocabulary) + 1
        often = np.bincount(tokens, minlength=codes)
        begin = np.cumsum(often) - often
        # every item's distinct words, the rarest in the shard first, and how many words of the item they make up
        at = np.flatnonzero(self.words)
        pair, times = np.unique(self.owner[at].astype(np.int64) * codes + self.words[at], return_counts=True)
        item, word = pair // codes, pair % codes
        order = np.lexsort((often[word], item))
        item, word, times = item[order], word[order], times[order]
        so_far = np.cumsum(times) - times
        so_far -= so_far[np.searchsorted(item, np.arange(len(self.ids)))][item]
        least = need - np.maximum(1, -(-need // 3))  # words that may be outside the rarest
        rare = so_far < (self.size - least)[item]
        held = np.bincount(item[rare], times[rare], len(self.ids)).astype(np.int64)
        enough = need - (self.size - held)
        item, word = item[rare], word[rare]
        hits = np.bincount(item, often[word], len(self.ids)).astype(np.int64)
        part = np.cumsum(hits) // HITS
        for block in np.unique(part):
            mine = part[item] == block
            k, n = item[mine], often[word[mine]]
            owner = np.repeat(k, n)
            p = places[np.repeat(begin[word[mine]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            key = np.sort(owner * len(tokens) + p)
            owner, p = key // len(tokens), key % len(tokens)
            last = np.arange(len(p)) + enough[owner] - 1
            near = np.minimum(last, len(p) - 1)
            ok = (last < len(p)) & (owner[near] == owner) & (p[near] - p < width[owner])
            k, lo, hi = owner[ok], np.maximum(p[near[ok]] - width[owner[ok]] + 1, 0), p[ok]
            if not len(k):
                continue
            fresh = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (lo > np.concatenate([[-1], hi[:-1]])))
            k, lo, hi = k[fresh], lo[fresh], hi[np.append(fresh[1:], len(hi)) - 1]
            size = np.minimum(hi + width[k], len(tokens)) - lo
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // HITS, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:]):
                yield self._counted(tokens, ends, need, width, pair, k[i:j], lo[i:j], hi[i:j], size[i:j])

    def _counted(self, tokens, ends, need, width, pair, k, lo, hi, size):
        """The stretches that begin at ``lo`` to ``hi``; ``pair``: all items' words, sorted."""
        piece = np.repeat(np.arange(len(k)), size)
        p = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[piece]
        want = k[piece] * (len(self.vocabulary) + 1) + tokens[p]
        own = (tokens[p] > 0) & (pair[np.minimum(np.searchsorted(pair, want), len(pair) - 1)] == want)
        total = np.concatenate([[0], np.cumsum(own)])
        at = np.flatnonzero(own & (p <= hi[piece]))
        k, p = k[piece[at]], p[at]
        words = total[at + np.minimum(width[k], ends[np.searchsorted(ends, p, "right")] - p)] - total[at]
        yes = words >= need[k]
        return k[yes], p[yes], words[yes]

    def ordered(self, item: int, stretch: np.ndarray) -> int:
        """Most words of an item that ``stretch`` holds in the item's order (bit-parallel)."""
        if self.masks[0] != item:
            own = self.words[self.start[item] : self.start[item] + self.size[item]]
            self.masks = item, {}
            for k, w in enumerate(own.tolist()):
                self.masks[1][w] = self.masks[1].get(w, 0) | 1 << k
        masks, size = self.masks[1], int(self.size[item])
        full = (1 << size) - 1
        row = full
        for w in stretch[stretch > 0].tolist():
            if m := masks.get(w):
                u = row & m
                row = (row + u | row - u) & full
        return size - row.bit_count()


def _loaded(block) -> Items:
    """Value of a broadcast block of items; with many blocks none stays in memory after its turn."""
    items = block.value
    if getattr(block, "_path", None) is not None and hasattr(block, "_value"):
        del block._value
    return items


def _held(items: Items, docs, tokens, starts, shortest: int, part: float, stretch: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, words held, item's words, place) of a shard of documents."""
    ends = np.append(starts[1:], len(tokens))
    a, p, n = items.matches(tokens, shortest)
    pair = np.searchsorted(ends, p, "right") * len(items.ids) + items.owner[a]
    order = np.lexsort((p, -n, pair))
    matched, first = np.unique(pair[order], return_index=True)
    longest = dict(zip(matched.tolist(), p[order[first]].tolist()))
    need, width = np.maximum(np.ceil(part * items.size).astype(np.int64), 1), (stretch * items.size + 0.5).astype(np.int64)
    best: dict[int, tuple[int, int]] = {}
    for k, p, n in items.stretches(tokens, ends, need, width):
        pair = np.searchsorted(ends, p, "right") * len(items.ids) + k
        order = np.lexsort((p, pair, k))
        last, skip = -1, 0
        for key, item, place, most in zip(*(x[order].tolist() for x in (pair, k, p, n))):
            d = key // len(items.ids)
            if key not in best:
                best[key] = int(need[item]) - 1, -1
                tries = [longest[key], place] if key in longest else [place]
            else:
                tries = [place]
            if key != last:
                last, skip = key, 0
            for start in tries:
                if most > best[key][0] and (start >= skip or start != place):
                    got = items.ordered(item, tokens[start : min(start + int(width[item]), ends[d])])
                    if got > best[key][0]:
                        best[key] = got, start - int(starts[d])
                    if start == place:  # a stretch that begins k words on holds k words more at most
                        skip = start + best[key][0] + 1 - got
    for key, (got, at) in best.items():
        if at >= 0:
            d, k = divmod(key, len(items.ids))
            yield int(docs[d]), int(items.ids[k]), got, int(items.size[k]), at


def _search(blocks: list, shortest: int, part: float, stretch: float) -> Callable:
    """Documents to the items they hold: every shard of documents meets all blocks of items in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(ids: list[np.ndarray], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            docs = np.concatenate(ids)
            for block in blocks:
                items = _loaded(block) if len(blocks) > 1 else block.value
                coded = [items.encode(t) for t in texts]
                tokens = np.concatenate([c[0] for c in coded])
                starts = np.concatenate([c[1][:-1] + s for c, s in zip(coded, np.cumsum([0, *(len(c[0]) for c in coded)]))])
                found = list(zip(*_held(items, docs, tokens, starts, shortest, part, stretch)))
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["doc_id", "item_id", "n_words", "item_words", "at_word"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for begin, some in chunks(batch.column(1)):
                ids.append(batch.column(0).slice(begin, len(some)).to_numpy())
                texts.append(some)
                size += some.nbytes
                if size >= SHARD:
                    yield from shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from shard(ids, texts)

    return run


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about ITEM_BLOCK characters; the driver holds one partition of them and one block at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.where("text is not null and item_id is not null").select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= ITEM_BLOCK:
            if len((block := Items(held)).ids):
                yield block
            held, size = [], 0
    if held and len((block := Items(held)).ids):
        yield block


_FOUND = "doc_id bigint, item_id bigint, n_words bigint, item_words bigint, at_word bigint"


def leaked(
    documents: DataFrame, items: DataFrame, part: float = 0.5, stretch: float = 1.5, shortest: int = 3,
) -> DataFrame:
    """``(doc_id, item_id, n_words, item_words, at_word)`` of documents that hold a test item.

    A document holds an item if at least ``part`` of the item's words stand in the
    item's order within a stretch of ``stretch`` times its length; signs of
    spaceless scripts count as words. Case, punctuation, markup and line breaks
    do not matter, and the words need not stand in runs: this is exact for items of
    any length (one of two words is held by a document with either word).
    ``shortest`` is the least verbatim match that is looked up; it only decides which
    stretch is compared first. Null and empty texts, texts without a word and rows
    without an id hold nothing and are held by none; either table may be empty.
    Texts are searched whole. ``documents`` needs ``doc_id`` and ``text``, ``items``
    ``item_id`` and ``text``; other columns are ignored, repeated documents come out
    again, of repeated items each.

    Items go out in blocks of ITEM_BLOCK characters, one broadcast each; documents
    are read once, whatever the number of blocks, and never shuffled.
    """
    spark = documents.sparkSession
    blocks = [spark.sparkContext.broadcast(block) for block in _item_blocks(items)]
    if not blocks:
        return spark.createDataFrame([], _FOUND)
    texts = documents.where("text is not null and text <> '' and doc_id is not null").select("doc_id", "text")
    return texts.mapInArrow(_search(blocks, shortest, part, stretch), _FOUND)


def whole_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of the leaks that hold all words of an item in its order within a stretch of its own length: verbatim copies."""
    return leaked(documents, items, part=1.0, stretch=1.0).select("doc_id", "item_id")


def without_leaks(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that hold no test item, all columns kept."""
    return documents.join(leaked(documents, items, **how).select("doc_id").distinct(), "doc_id", "left_anti")
