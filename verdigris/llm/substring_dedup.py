"""Removal of repeated word passages by prefix-partitioned suffix trees.

In the tree of all word suffixes a passage of ``window`` words that occurs twice is an internal
node at that depth or deeper. The tree is never built as one: suffixes are split by prefixes of
two lengths into groups that fit a task, and only groups that can hold a deep node go on.

1. Every window has one anchor, its ANCHOR-word run with the smallest digest. Equal windows
   have equal anchors, so windows whose anchor occurs once in the corpus are leaves and end here.
2. The suffixes left are split by their ``window``-word prefix. Sorted by document and place,
   the first suffix of a group is its node's first occurrence and all others are repeats.

Each task first folds what repeats within its own slice of documents and sends one suffix per
prefix, so a passage that a third of all documents share reaches a group at most once per slice.
Prefixes are told apart by digests of 96 bits, which 10**13 windows leave far from a collision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.arrow import arrow_map, field, fresh, row_ids
from verdigris.llm.words import Words, mix, runs, slices
from verdigris.session import materialize

ANCHOR = 5
SLICE = 3 << 20
GATHER, LIST = 1 << 19, 8
CHECK_BITS = (1 << 32) - 1


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window inside one text, the word its anchor begins at, and the word digests."""
    hashes = words.hashes()
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    starts = np.flatnonzero(words.row[:n] == words.row[window - 1 :])
    grams = runs(hashes, ANCHOR)
    offset = np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1)[:n].argmin(axis=1)
    return starts, starts + offset[starts], hashes


def _first_of_equal(digest: np.ndarray, check: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which rows are the first of their digest in the given order."""
    by = np.lexsort((order, check, digest))
    first = np.empty(len(by), bool)
    first[by] = ~_repeats_equal(digest[by], check[by])[0]
    return first


def _runs_over_batches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches cut so that rows with one key are never split."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        keys = t.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _by_document(kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of a document and up to LIST of its places, from rows of (document, place)."""
    rid, start = (np.concatenate([k[n] for k in kept]) for n in (0, 1))
    by = np.lexsort((start, rid))
    rid, start = rid[by], start[by]
    new = np.concatenate([[True], rid[1:] != rid[:-1]])
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero(new | ((np.arange(len(rid)) - begin) % LIST == 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rid)).astype(np.int32)), pa.array(start))
    return pa.RecordBatch.from_arrays([pa.array(rid[first]), lists], ["rid", "starts"])


def _repeats_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by all keys: not the first of its run; in a run of two or more."""
    later = np.zeros(len(keys[0]), bool)
    later[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    many = later.copy()
    many[:-1] |= later[1:]
    return later, many


def _packed(start: np.ndarray, check: np.ndarray) -> np.ndarray:
    """First word and check digest of a window in one number, check low.

    Beside the key its changing bytes are then one run, and the zeros of the first word join the
    columns that stay: a compressed exchange breaks each row once.
    """
    return (start.astype(np.int64) << 32) | check.astype(np.int32).view(np.uint32).astype(np.int64)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (place >> 32).astype(np.int32), (place & CHECK_BITS).astype(np.uint32).view(np.int32)


def repeated_words(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Word statistics of every row, and the rows that lose words.

    The first frame has (rid, id, n_words, kept_sha256 as if nothing went) for every row, the
    second (rid, text, first words of the repeated windows). ``docs`` must be a stored table.
    """
    rows = docs.select(row_ids(docs).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_field = rows.schema["id"]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out = [packer.compress(t.encode()) if t is not None else None for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["rid", "id", "packed"])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column(1), SLICE):
                words = Words(part)
                starts, anchor, hashes = _windows(words, window)
                place = np.unique(anchor)
                if not len(place):
                    continue
                digest = runs(hashes, ANCHOR)[place]
                row = words.row[place]
                rid = b.column(0).to_numpy()[row + at]
                by = np.argsort(digest, kind="stable")
                later, many = _repeats_equal(digest[by])
                # Repeats inside the slice are known; the first one asks the other slices.
                key = np.where(later, mix(rid[by].astype(np.uint64)), digest[by])
                order = np.argsort(rid[by], kind="stable")  # rows of a document together compress better
                pos = (place - words.first[row]).astype(np.int32)[by]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)[order]), pa.array(pos[order]), pa.array(rid[by][order]), pa.array(many[order])],
                    ["key", "pos", "rid", "known"],
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for t in _runs_over_batches(batches, "key"):
            _, many = _repeats_equal(t.column("key").to_numpy())
            many |= t.column("known").to_numpy(zero_copy_only=False)
            kept.append((t.column("rid").to_numpy()[many], t.column("pos").to_numpy()[many]))
            held += int(many.sum())
            if held >= GATHER:
                yield _by_document(kept)
                kept, held = [], 0
        if held:
            yield _by_document(kept)

    found = arrow_map(rows.select("rid", "text"), anchors, [field("key", "bigint"), field("pos", "int"), field("rid", "bigint"), field("known", "boolean")])
    alive = arrow_map(found.repartition("key").sortWithinPartitions("key"), shared, [field("rid", "bigint"), field("starts", "array<int>")])
    per_doc = alive.groupBy("rid").agg(F.flatten(F.collect_list("starts")).alias("anchors"))  # at most the document's own
    packed = arrow_map(rows, squeeze, [rows.schema["rid"], id_field, field("packed", "binary")])
    candidates = materialize(packed.join(per_doc, "rid"), "candidates")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            text = pa.array([opener.decompress(x) for x in b.column(2).to_pylist()], pa.large_binary()).cast(pa.large_string())
            ids, rids = b.column(1).to_pylist(), b.column(0).to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], rids[i]))] = np.arange(len(ids))
            for at, part in slices(text, SLICE):
                words = Words(part)
                starts, anchor, hashes = _windows(words, window)
                if not len(starts):
                    continue
                chosen = np.zeros(len(hashes), bool)
                lists = b.column(3).slice(at, len(part))
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                chosen[words.first[owner] + lists.flatten().to_numpy()] = True
                starts = starts[chosen[anchor]]
                digest = runs(hashes, window)[starts]
                check = (runs(hashes, window, stream=1)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row = words.row[starts]
                place = starts - words.first[row]
                first = _first_of_equal(digest, check, (rank[row + at] << 32) | place)
                rid = rids[row + at]
                key = np.where(first, digest, mix(rid.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(_packed(place, np.where(first, check, 0))), b.column(1).take(pa.array(row + at)), pa.array(rid), pa.array(~first)],
                    ["key", "place", "id", "rid", "known"],
                )

    def later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for t in _runs_over_batches(batches, "key"):
            # Known repeats carry keys of their own; if one meets a digest it must not hide a first.
            known = t.column("known").to_numpy(zero_copy_only=False)
            later = known.copy()
            asked = np.flatnonzero(~known)
            start, check = _unpacked(t.column("place").to_numpy())
            later[asked] = _repeats_equal(t.column("key").to_numpy()[asked], check[asked])[0]
            kept.append((t.column("rid").to_numpy()[later], start[later]))
            held += int(later.sum())
            if held >= GATHER:
                yield _by_document(kept)
                kept, held = [], 0
        if held:
            yield _by_document(kept)

    sent = arrow_map(
        candidates, suffixes, [field("key", "bigint"), field("place", "bigint"), id_field, field("rid", "bigint"), field("known", "boolean")]
    )
    check = F.col("place").bitwiseAND(F.lit(CHECK_BITS))
    grouped = sent.repartition("key").sortWithinPartitions("key", check, F.col("id").asc_nulls_last(), "rid", "place")
    repeats = arrow_map(grouped, later_ones, [field("rid", "bigint"), field("starts", "array<int>")])
    lists = materialize(repeats.groupBy("rid").agg(F.flatten(F.collect_list("starts")).alias("starts")), "repeats")  # at most the document's windows
    losing = candidates.select("rid", "packed").join(lists, "rid")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha = [], []
            for t in b.column(2).to_pylist():
                words = (t or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["rid", "id", "n_words", "sha"])

    all_rows = arrow_map(rows, whole, [rows.schema["rid"], id_field, field("n_words", "bigint"), field("sha", "string")])
    return all_rows, losing


def _kept(text: bytes, starts: list[int], window: int) -> tuple[list[bytes], int]:
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


def _after(losing: DataFrame, window: int, make, schema) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            kept = [_kept(opener.decompress(x), s, window) for x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield make(b.column(0), kept)

    return arrow_map(losing, apply, schema)


def repeat_report(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row.

    A word goes if a window of ``window`` words over it also starts earlier: in a document with
    a smaller id, or earlier in its own. Null ids come last; rows with one id keep the order of
    the stored table, so of repeated rows the first keeps its words. Null and empty texts have
    no words. An empty table gives an empty table; other columns are ignored.
    """
    everyone, losing = repeated_words(docs, window, id_col, text_col)

    def make(rid, kept):
        sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in kept]
        return pa.RecordBatch.from_arrays([rid, pa.array([n for _, n in kept], pa.int64()), pa.array(sha, pa.string())], ["rid", "gone", "new_sha"])

    changed = _after(losing, window, make, [field("rid", "bigint"), field("gone", "bigint"), field("new_sha", "string")])
    return everyone.join(changed, "rid", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha", "sha").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in all their columns; texts that lose words keep the others, joined by one space.

    What goes is what ``repeat_report`` counts. Texts that lose nothing come back unchanged, null
    texts as null, a text that loses all its words as an empty one; of repeated rows the first
    keeps its words. An empty table gives an empty table.
    """
    _, losing = repeated_words(docs, window, id_col, text_col)
    row, new_text = fresh("_rid", docs.columns), fresh("_text", docs.columns)

    def make(rid, kept):
        return pa.RecordBatch.from_arrays([rid, pa.array([b" ".join(w).decode() for w, _ in kept], pa.string())], [row, new_text])

    changed = _after(losing, window, make, [field(row, "bigint"), field(new_text, "string")])
    rows = docs.select(*docs.columns, row_ids(docs).alias(row)).join(changed, row, "left")
    return rows.select(*[F.coalesce(new_text, text_col).alias(c) if c == text_col else F.col(c) for c in docs.columns])
