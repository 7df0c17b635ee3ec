"""Compressed bitmaps of ids per group and bucket, with popcount directories and rank queries.

Bucket b of a group holds the ids in [b * 65536, (b + 1) * 65536). Its container is the sorted
16-bit low parts while there are fewer than 4096 of them, and a bitmap of 65536 bits beyond.
How often an id occurs beyond once is kept beside it, so ranks count rows, not distinct ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 1 << 16
DENSE, BLOCK = 4096, 1024
_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)

COLUMNS = [("group", "string"), ("bucket", "bigint"), ("ids", "binary"), ("again", "binary"), ("more", "binary"), ("n", "bigint")]


def pack(low: np.ndarray) -> bytes:
    """Container of sorted distinct low parts."""
    if len(low) < DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(WIDTH, bool)
    bits[low] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    if len(container) < 2 * DENSE:
        return np.frombuffer(container, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little"))


class Ranks:
    """Rank queries on one container."""

    def __init__(self, container: bytes, again: bytes, more: bytes):
        self.dense = len(container) >= 2 * DENSE
        if self.dense:
            self.bits = np.frombuffer(container, np.uint8)
            # Set bits before every block of the bitmap.
            counts = _ONES[self.bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            self.directory = np.cumsum(counts) - counts
            self.words = self.bits.reshape(-1, BLOCK // 8)
        else:
            self.low = np.frombuffer(container, "<u2")
        self.again = np.frombuffer(again, "<u2")
        more = np.frombuffer(more, "<i8")
        self.before = np.concatenate([[0], np.cumsum(more)])

    def rank(self, low: np.ndarray) -> np.ndarray:
        """Rows with a smaller id."""
        if self.dense:
            block, bit = low // BLOCK, low % BLOCK
            byte = bit // 8
            whole = np.where(np.arange(BLOCK // 8) < byte[:, None], _ONES[self.words[block]], 0).sum(axis=1)
            part = _ONES[self.words[block, byte] & ((1 << (bit % 8)) - 1).astype(np.uint8)]
            distinct = self.directory[block] + whole + part
        else:
            distinct = np.searchsorted(self.low, low.astype("<u2"))
        return distinct + self.before[np.searchsorted(self.again, low.astype("<u2"))]

    def repeated(self, low: np.ndarray) -> np.ndarray:
        return np.isin(low.astype("<u2"), self.again)


def _row(low: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    twice = times > 1
    return pack(low), low[twice].astype("<u2").tobytes(), (times[twice] - 1).astype("<i8").tobytes(), int(times.sum())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c for c, _ in COLUMNS])


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of the (group, id) rows of each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0).dictionary_encode()
        ids = b.column(1).to_numpy()
        code = names.indices.to_numpy()
        by = np.lexsort((ids, code))
        code, ids = code[by], ids[by]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(ids)))
        code, ids = code[first], ids[first]
        bucket = ids >> 16
        new = np.ones(len(ids), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])
        cuts = np.append(np.flatnonzero(new), len(ids))
        words = names.dictionary.to_pylist()
        yield _batch([(words[code[a]], int(bucket[a]), *_row(ids[a:z] & (WIDTH - 1), times[a:z])) for a, z in zip(cuts, cuts[1:])])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One container per (group, bucket) from rows that come together; any number of them streams through."""
    key, times, out = None, None, []

    def finish():
        low = np.flatnonzero(times)
        return (*key, *_row(low, times[low]))

    for b in batches:
        for group, bucket, ids, again, more, _ in zip(*(c.to_pylist() for c in b.columns)):
            if (group, bucket) != key:
                if key is not None:
                    out.append(finish())
                    if len(out) >= 256:
                        yield _batch(out)
                        out = []
                key, times = (group, bucket), np.zeros(WIDTH, np.int64)
            times[unpack(ids)] += 1
            times[np.frombuffer(again, "<u2")] += np.frombuffer(more, "<i8")
    if key is not None:
        yield _batch([*out, finish()])
