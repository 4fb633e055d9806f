"""Vectorised reading of Arrow string batches as UTF-8 bytes: words, their 64-bit hashes, and byte features.

A word is a run of bytes that a 256-entry table marks as word bytes; every non-ASCII byte is one, so a table of
ASCII separators works on UTF-8 without decoding. A hash mixes each lane of eight bytes under a key of its own and adds
the lanes up; no text is known that collides by its structure, and chance collisions of 64 bits are as rare as they are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


#: Of each count of bytes, the bits of a lane that they fill.
_LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LANE_STEP = np.uint64(0x9E3779B97F4A7C15)


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in lanes of eight bytes: (lanes, number of each lane in its span, first lane of each span).

    The last lane of a span is filled up with zeros. An empty span has one empty lane.
    """
    sizes = ends - starts
    each = np.maximum((sizes + 7) >> 3, 1)
    upto = np.cumsum(each)
    first = upto - each
    padded = np.empty(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    windows = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    if len(each) == 0 or int(each.max()) == 1:
        return windows[starts] & _LANE_MASKS[sizes], np.zeros(len(sizes), np.int64), first
    number = np.arange(int(upto[-1])) - np.repeat(first, each)
    out = windows[np.repeat(starts, each) + (number << 3)]
    last = upto - 1
    out[last] &= _LANE_MASKS[sizes - ((each - 1) << 3)]
    return out, number, first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand.

    Each lane is mixed by itself under a key of its number before lanes are added, so no run of bytes cancels another's.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        own, number, first = lanes(data, starts, ends)
        h = mix64(own ^ (number + 1).astype(np.uint64) * _LANE_STEP)
        if len(h) > len(starts):
            h = np.add.reduceat(h, first)
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span holds the very bytes of span number ``other``."""
    out = (ends - starts) == (ends - starts)[other]
    own, number, first = lanes(data, starts, ends)
    each = np.diff(np.append(first, len(own)))
    span = np.repeat(np.arange(len(starts)), each)
    there = np.minimum(first[other][span] + number, len(own) - 1)
    differ = own[there] != own
    if differ.any():
        out[span[differ]] = False
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into slices of about ``limit`` bytes of ``text``: (slice, bytes, offsets). No text is cut."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def _hold(mapped: int, trimmed: int) -> None:
    """From how many bytes on glibc maps an array by itself, and hands free memory back; other allocators are left alone."""
    put = getattr(ctypes.CDLL(None), "mallopt", None)
    if put:
        put(-3, mapped)  # M_MMAP_THRESHOLD
        put(-1, trimmed)  # M_TRIM_THRESHOLD


def hold() -> None:
    """Keep a block's free memory for the next one until ``settle``: its arrays would be mapped and cleared anew each time."""
    _hold(4 << 20, 64 << 20)


def settle() -> None:
    """Hand free memory back at the end of a task: a worker lives on, and its allocators would keep what they had."""
    pa.default_memory_pool().release_unused()
    _hold(128 << 10, 128 << 10)
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Maps A-Z to a-z and leaves other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space (space, tab to carriage return) separates.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words after lower-casing: digits, a-z and all non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Words:
    """Words of a block of documents: byte spans, hashes, and the first word of each document (``bounds``, n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        low = LOWER[data]
        n = len(low)
        inside = table[low]
        edge = np.zeros(n + 1, dtype=bool)
        if n:
            edge[1:n] = inside[1:] != inside[:-1]
            edge[0], edge[n] = inside[0], inside[-1]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            joined = cut[inside[cut - 1] & inside[cut]]  # two texts meet inside a run of word bytes
        else:
            joined = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        if len(joined):
            at = np.sort(np.concatenate([at, np.unique(joined), np.unique(joined)]))
        self.low, self.starts, self.ends = low, at[0::2], at[1::2]
        self.bounds = np.searchsorted(self.starts, offsets, side="left")
        self.bounds[-1] = len(self.starts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.low, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1, joined by single spaces."""
        return " ".join(bytes(self.low[a:b]).decode("utf-8", "replace") for a, b in zip(self.starts[i:j], self.ends[i:j]))


_GRAM = [np.uint64(pow(0xA0761D6478BD642F, j, 1 << 64)) for j in range(64)]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; position i covers words i to i + k - 1, across document bounds as well."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += hashes[j : j + n] * _GRAM[j + 1]
        return mix64(out + np.uint64(k))


def gram_counts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, dims: int, step: int = BLOCK_BYTES, squeeze: int = -1) -> np.ndarray:
    """Counts of hashed byte trigrams per document, (n, dims); bytes go through ``table`` first.

    ``squeeze``: runs of this symbol count as one. Works through any length in steps, so memory doesn't follow a long text.
    """
    n = len(offsets) - 1
    out = np.zeros(n * dims)
    for a in range(0, len(data), step):
        b = min(a + step, len(data))
        part = table[data[a : min(b + 2, len(data))]].astype(np.uint32)
        at = np.arange(a, a + len(part))
        if squeeze >= 0:
            keep = np.ones(len(part), bool)
            keep[1:] = ~((part[1:] == squeeze) & (part[:-1] == squeeze))
            part, at = part[keep], at[keep]
        if len(part) < 3:
            continue
        doc = np.searchsorted(offsets, at, side="right") - 1
        same = (doc[2:] == doc[:-2]) & (at[:-2] < b)
        code = part[:-2] * np.uint32(65536) + part[1:-1] * np.uint32(256) + part[2:]
        h = (code * np.uint32(2654435761)) >> np.uint32(32 - (dims - 1).bit_length())
        out += np.bincount((doc[:-2] * dims + h)[same], minlength=n * dims)
    return out.reshape(n, dims)
