"""Flat numpy views of an Arrow text column: words, their hashes and sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 21

#: Separators of whitespace words, `[^\x20\x09-\x0D]+`.
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their int64 offsets; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators; and the first word of each row (rows + 1).

    A word never runs across two rows.
    """
    inside = ~separator[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, in place."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a round."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    left = ends - starts
    result = mix(left.astype(U64) + U64(0x9E3779B97F4A7C15))
    chosen, at = np.arange(len(starts)), starts
    while len(chosen):
        piece = eights[at] & _TAIL[np.minimum(left, 8)]
        result[chosen] = mix(result[chosen] * U64(0x9FB21C651E98DF25) + piece)
        more = left > 8
        chosen, at, left = chosen[more], at[more] + 8, left[more] - 8
    return result


class SortedHashes:
    """Positions of 64-bit keys in a sorted array; leading bits point to the bucket where a search starts."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, U64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, min(22, int(len(keys)).bit_length()))
        self.shift = U64(64 - bits)
        edges = np.arange(1 << bits, dtype=U64) << self.shift
        self.first = np.searchsorted(keys, edges).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, or -1."""
        last = len(self.keys) - 1
        at = self.first[wanted >> self.shift]
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[(at[behind] < last) & (self.keys[at[behind]] < wanted[behind])]
        return np.where((self.keys[at] == wanted) & (at < last), at, -1)


class PackedKeys:
    """Positions of 64-bit keys of any kind in an ascending array: a sorted hash array of the scrambled keys."""

    def __init__(self, keys: np.ndarray):
        scrambled = mix(keys.copy())
        order = np.argsort(scrambled)
        self.hashes = SortedHashes(scrambled[order])
        self.place = np.append(order, -1).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key in the array given, or -1."""
        return self.place[self.hashes.find(mix(wanted.copy()))]


class KeyCounts:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.held.append((found, counts))
        self.size += len(found)

    def merge(self) -> None:
        if len(self.held) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.held))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.held = [(keys[first], np.add.reduceat(counts, first))]
            self.size = len(first)

    def taken(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The merged keys and counts, which are let go."""
        self.merge()
        held, self.held, self.size = self.held, [], 0
        return held
