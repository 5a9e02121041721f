"""Text columns as arrays of code points, folded and cut into words by table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNKNOWN = np.uint32(0xFFFFFFFF)
SKIP = np.uint32(0xFFFFFFFE)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
# Signs that show nothing and part no word.
INVISIBLE = "­​‌‍⁠﻿"


class Table:
    """Code point to folded code, filled as code points turn up; 0 is a separator."""

    def __init__(self, keep, skip: str = ""):
        self.keep, self.skip = keep, skip
        self.codes = np.full(0x110000, UNKNOWN, np.uint32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.codes[codes]
        if len(out) and out.max() == UNKNOWN:
            for code in np.unique(codes[out == UNKNOWN]):
                ch = chr(code)
                low = next((x for x in (ch.casefold(), ch.lower()) if len(x) == 1), ch)
                self.codes[code] = SKIP if ch in self.skip else ord(low) if self.keep(ch) else 0
            out = self.codes[codes]
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values end to end, and the offsets of each value; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_codes(data: np.ndarray, table: Table) -> np.ndarray:
    """Folded code at the first byte of every kept letter, 0 at all other bytes of the UTF-8 stream."""
    out = table(np.minimum(data, 128)) if len(data) else np.zeros(0, np.uint32)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        code = (first & np.array([0x1F, 0x0F, 0x07], np.uint8)[size - 2]).astype(np.uint32)
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (data[lead[more] + k] & 0x3F)
        out[lead] = table(code)
    return out


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; at least n of them."""
    have = _powers.get(int(base), ())
    if len(have) < n:
        have = np.full(max(n, 2 * len(have), 1024), base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have


def mixed(codes: np.ndarray) -> np.ndarray:
    value = codes.astype(np.uint64)
    value = (value ^ (value << np.uint64(29))) * MIX
    value ^= value >> np.uint64(31)
    return value


def code_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values end to end (bytes if all is ASCII), and the offsets of each value; nulls are empty."""
    data, offsets = text_bytes(column)
    if len(data) and data.max() >= 128:
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        data = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        offsets = starts[offsets]
    return data, offsets


def chunks(column: pa.Array, most: int = 400_000):
    """Slices of a text column of about ``most`` bytes each, a longer value alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, column.slice(begin, k - begin)
            begin, total = k, 0
        total += int(n)
    if begin < len(column):
        yield begin, column.slice(begin)


# Ranges of scripts written without spaces, taken sign by sign.
SPACELESS = ((0x0E00, 0x0E7F), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_word = Table(str.isalnum, INVISIBLE)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every folded word of all values, and the offsets of each value's words.

    A word is a run of letters and digits; signs of spaceless scripts are words.
    """
    data, offsets = code_units(column)
    folded = _word(data)
    if len(folded) and folded.max() == SKIP:
        seen = folded != SKIP
        offsets = np.concatenate([[0], np.cumsum(seen)])[offsets]
        folded = folded[seen]
    inside = folded != 0
    sign = np.zeros(len(folded) + 1, bool)
    if data.dtype != np.uint8:
        for lo, hi in SPACELESS:
            sign[1:] |= (folded >= lo) & (folded <= hi)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | sign[2:] | sign[1:-1]
    if len(first):
        at = offsets[:-1][offsets[:-1] < len(first)]
        first[at] = inside[at]
    starts = np.flatnonzero(first)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(inside, mixed(folded), np.uint64(0)) * powers(BASE, len(folded) + 1)[: len(folded)], dtype=np.uint64)])
    ends = np.append(starts[1:], len(folded))[: len(starts)]
    hashes = (total[ends] - total[starts]) * powers(INVERSE, len(folded) + 1)[starts]
    return hashes, np.searchsorted(starts, offsets)
