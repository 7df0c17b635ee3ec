"""Words of whole texts as flat arrays, straight from Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D; UTF-8 never uses those inside a
character. A word's hash is a sum over its 8-byte blocks, each added to a key of its place and
mixed over 64 bits first; runs of words combine the hashes of shorter runs, mixed at every
step. Plain polynomials modulo 2**64 would not do: words of two letters in a Thue-Morse order
and with the letters swapped have equal sums whatever the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
CHUNK = 1 << 16
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a text column of at most ``limit`` bytes (one longer text alone), with their first row."""
    arr = arr.cast(pa.large_string())
    sizes = np.diff(_offsets(arr))
    at = 0
    ends = np.cumsum(sizes)
    while at < len(arr):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, arr.slice(at, to - at)
        at = to


def _offsets(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]


class Words:
    """Words of a slice of texts: byte range, row, and per row the first word and the count.

    A null text has no words.
    """

    def __init__(self, arr: pa.Array, lower: bool = False):
        arr = arr.cast(pa.large_string()).fill_null("")
        off = _offsets(arr) if len(arr) else np.zeros(1, np.int64)
        self.data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(arr) else np.zeros(0, np.uint8)
        off = off - off[0]
        self.offsets = off
        if lower:
            self.data = _LOWER[self.data]
        full = ~_GAP[self.data]
        cut = np.zeros(len(self.data) + 1, bool)  # a text begins here
        cut[off] = True
        n = len(full)
        start, stop = full.copy(), full.copy()
        if n:
            start[1:] &= ~full[:-1] | cut[1:n]
            stop[:-1] &= ~full[1:] | cut[1:n]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, off[:-1])
        self.count = np.searchsorted(self.starts, off[1:]) - self.first
        self.row = np.repeat(np.arange(len(arr)), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        block = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from any place on
        out = np.empty(len(self.starts), np.uint64)
        for at in range(0, len(out), CHUNK):  # what is made on the way stays small
            starts, ends = self.starts[at : at + CHUNK], self.ends[at : at + CHUNK]
            size = (ends - starts).astype(np.uint64)
            total = mix((block[starts] & _first_bytes(size)) + _PLACE)
            long = np.flatnonzero(size > 8)
            if len(long):
                total[long] += _later_blocks(block, starts[long], size[long])
            out[at : at + CHUNK] = mix(total + size * _LENGTH)
        return out


def _later_blocks(block: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum over a word's blocks from the second on, for words of more than 8 bytes."""
    more = (size.astype(np.int64) - 1) // 8
    first = np.cumsum(more) - more
    nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
    at = np.repeat(starts, more) + 8 * nth
    left = np.repeat(size, more) - (8 * nth).astype(np.uint64)
    return np.add.reduceat(mix((block[at] & _first_bytes(left)) + mix((nth + 1).astype(np.uint64) * _PLACE)), first)


def _first_bytes(size: np.ndarray) -> np.ndarray:
    """Masks of the first ``size`` (at least 1) bytes of a block."""
    return ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(size, np.uint64(8)))


def runs(hashes: np.ndarray, size: int, stream: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; the last ``size - 1`` places are absent.

    Hashes of different streams are independent of each other.
    """
    out = np.empty(max(0, len(hashes) - size + 1), np.uint64)
    for at in range(0, len(out), CHUNK):
        out[at : at + CHUNK] = _runs(hashes[at : at + CHUNK + size - 1], size, stream)
    return out


def _runs(hashes: np.ndarray, size: int, stream: int) -> np.ndarray:
    odd = np.uint64((int(_LENGTH) + 2 * 0x9E3779B97F4A7C15 * stream) % (1 << 64) | 1)
    short = hashes if stream == 0 else mix(hashes + odd)
    out, have, width = None, 0, 1
    while have < size:
        if size & width:
            n = max(0, len(hashes) - have - width + 1)
            out = short[:n] if out is None else mix(out[:n] * odd + short[have : have + n])
            have += width
        if have < size:
            short = mix(short[: max(0, len(short) - width)] * odd + short[width:])
            width *= 2
    return out


def word_counts(arr: pa.Array) -> np.ndarray:
    out = np.zeros(len(arr), np.int64)
    for at, part in slices(arr):
        out[at : at + len(part)] = Words(part).count
    return out
