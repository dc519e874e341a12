"""Words of Arrow text columns as numpy arrays, for use inside Spark tasks.

Every operator here cuts text at ASCII bytes only, so UTF-8 is cut without
decoding it. A column is worked through in pieces of about ``PIECE`` bytes, cut
between words: memory per task follows the piece, not the batch or the document.
Hashes are 64 bits; an operator that needs more says what it checks besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
# Text handed to an operator at once, in bytes; a longer document comes alone.
SLICE = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _SPREAD
    h = (h ^ (h >> np.uint64(32))) * _SPREAD
    return h ^ (h >> np.uint64(32))


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _ODD)]), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _ODD)]), dtype=np.uint64)
    return _POWERS


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make words, and what each byte counts as."""

    inside: np.ndarray
    value: np.ndarray
    # A word also ends between a byte of ``left`` and one of ``right``.
    left: np.ndarray | None = None
    right: np.ndarray | None = None


def _alphabet(inside: np.ndarray, lower: bool, left=None, right=None) -> Alphabet:
    as_byte = np.arange(256)
    if lower:
        as_byte[65:91] += 32
    return Alphabet(inside, _BYTE_VALUE[as_byte], left, right)


_ANY = np.ones(256, bool)
_SPACED = _ANY.copy()
_SPACED[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# [^\x20\x09-\x0D]+ as they stand, the same with A-Z lower-cased, and
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
SPACED = _alphabet(_SPACED, lower=False)
SPACED_LOWER = _alphabet(_SPACED, lower=True)
ALNUM_LOWER = _alphabet(_ALNUM, lower=True)

# The second, cut between an ASCII letter and an ASCII mark after it.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
PIECES_LOWER = _alphabet(_SPACED, lower=True, left=_LETTER, right=_MARK)


@dataclass(frozen=True)
class Words:
    """Words of some texts: byte places in ``data``, hashes, and per text the first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1 entries
    text_start: np.ndarray  # byte places of the texts, len(texts) + 1 entries

    @property
    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    place = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[place[0] : place[-1]], place - place[0]


def _piece(data: np.ndarray, breaks: np.ndarray, letters: Alphabet):
    inside = letters.inside[data]
    open_ = inside.copy()
    open_[1:] &= ~inside[:-1]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    if letters.left is not None:
        cut = letters.left[data[:-1]] & letters.right[data[1:]]
        open_[1:] |= cut
        close[:-1] |= cut
    if len(breaks):  # a text's end also ends a word
        open_[breaks] = inside[breaks]
        close[breaks[breaks > 0] - 1] = inside[breaks[breaks > 0] - 1]
    start = np.flatnonzero(open_)
    end = np.flatnonzero(close) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    size = end - start
    begin = np.cumsum(size) - size
    within = np.arange(begin[-1] + size[-1]) - np.repeat(begin, size)
    value = letters.value[data[inside]] * _powers(int(size.max()))[within]
    return start, end, mix(np.add.reduceat(value, begin) + size.astype(np.uint64))


def words_of(column: pa.Array, letters: Alphabet) -> Words:
    """All words of a text column."""
    data, offsets = text_bytes(column)
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data):  # cut where no word is cut
            outside = np.flatnonzero(~letters.inside[data[stop : stop + PIECE]])
            edge = offsets[np.searchsorted(offsets, stop)]
            reach = stop + outside[0] if len(outside) else stop + PIECE
            if len(outside) or edge <= reach:
                stop = int(min(reach, edge))
                break
            stop += PIECE
        stop = min(stop, len(data))
        cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        s, e, h = _piece(data[at:stop], cut, letters)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = stop
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = joined(starts, np.int64)
    return Words(
        data, start, joined(ends, np.int64), joined(hashes, np.uint64),
        np.searchsorted(start, offsets), offsets,
    )


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbours; ``len(h) - k + 1`` entries (none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, block, done, out = np.array([_ODD]), 1, h, 0, None
    rest = k
    while rest:
        if rest & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += size
        rest >>= 1
        if rest:
            block = block[:-size] * power + block[size:]
            power, size = power * power, 2 * size
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
