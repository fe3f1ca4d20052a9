"""Words of UTF-8 text columns as numpy arrays: no Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes of the contracts. Bytes from 0x80 belong to code points above ASCII, which are in both classes.
_ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
_SOLID = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])  # [^\x20\x09-\x0D]
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 if k < 8 else 0xFFFFFFFFFFFFFFFF for k in range(9)], dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, eight zero bytes added, and where each text begins (one more entry: the end). Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    out = np.zeros(last - first + 8, dtype=np.uint8)
    if data is not None and last > first:
        out[: last - first] = np.frombuffer(data, dtype=np.uint8)[first:last]
    return out, offsets - first


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of a chunk of documents: byte spans, and the number of the first word of each document (one more entry: the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def split_words(data: np.ndarray, offsets: np.ndarray, kind: str) -> Words:
    """kind 'alnum': the data must be in lower case; 'solid': anything but ASCII white space. No word spans two documents."""
    mask = (_ALNUM if kind == "alnum" else _SOLID)[data]
    mask[offsets[-1] :] = False
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[begins[1:] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes in every chunk and every run. data ends in eight spare bytes."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * _M1
    at, left, rows = starts, length, None
    while len(at):
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        if rows is None:
            h = mixed(h ^ part)
        else:
            h[rows] = mixed(h[rows] ^ part)
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, one for each place where n words follow. Order counts: what stands before is multiplied, so
    that neither two words the other way round nor a word twice meets another pair."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out = mixed(out * _M1 ^ h[k : k + m])
    return out


def joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with exactly one space after each: the bytes, and where each word starts and ends in them."""
    data = words.data
    keep = np.zeros(len(data), dtype=bool)
    length = words.ends - words.starts
    new_starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]]) if len(length) else length
    delta = np.zeros(len(data) + 1, dtype=np.int8)
    delta[words.starts] = 1
    np.add.at(delta, words.ends, -1) if len(length) else None
    keep = np.cumsum(delta[:-1], dtype=np.int8).astype(bool)
    packed = data[keep]
    out = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
    hole = np.zeros(len(out), dtype=bool)
    hole[new_starts + length] = True
    out[~hole] = packed
    return out, new_starts, new_starts + length
