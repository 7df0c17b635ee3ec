"""Exact set-similarity components over word shingles, with set-relation skipping.

Sets A, B are linked if |A & B| / |A | B| >= percent / 100, that is if they differ in at most
D = (|A| + |B|) * (100 - percent) / (100 + percent) shingles.

Index skipping: a set lies in the order of its shingle digests and is cut by position (equal
ranges of the digest) into more than D blocks. Linked sets differ in at most D blocks, so they
agree in one that holds something (a set with too few such blocks lists its empty ones too);
the index lists whole blocks by digest, and every list whose block differs is skipped.
Size classes fix the number of blocks: a pair lies in one class or in two neighboring ones,
which share a second set of block lists.

Answer skipping: the sets on one list form a group with its first set as pivot. A group is cut
into cells of bounded size, the pivot is copied to each, and a cell compares its own sets and
the pivot; in a cell each set is held as its difference from what most of the cell share, and
the overlap of two sets follows from the common answer and their two small differences. A set
that is connected with the pivot needs no more: its component is the pivot's. Of the others,
the answer known so far, the distance to the pivot, bounds all further ones: two sets whose
distances to the pivot differ by more than D cannot link. So what is left of a group lies in
the order of that distance, is cut by position into blocks, and only pairs of blocks within D
that hold an unconnected set are compared. Cells report spanning forests, never pairs, and
the rows sent grow with the group, and beyond it only with its unconnected sets.

Equal sets are folded before all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.running import ranked
from verdigris.llm.arrow import arrow_map, field, fresh, row_ids
from verdigris.llm.embedding_dups import _union
from verdigris.llm.substring_dedup import _runs_over_batches
from verdigris.llm.words import Words, mix, runs, slices
from verdigris.operators.components import component_labels
from verdigris.session import discard, materialize

CELL = 256
GROWTH = 1.7
COLUMNS = 4096
_SHORT = np.uint64(0xA5A5F00DC0FFEE11)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle digests of every text, sorted within it, and where each text's begin.

    A text with fewer than ``size`` words has its whole sequence as one shingle, one without
    words has none.
    """
    hashes, row = words.hashes(), words.row
    grams = runs(hashes, size)
    inside = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], row[: len(grams)][inside]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        total = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            there = words.count[few] > k
            total[there] = mix(total[there] * np.uint64(3) + hashes[words.first[few[there]] + k] + _SHORT)
        grams, owner = np.concatenate([grams, total]), np.concatenate([owner, few])
    by = np.lexsort((grams, owner))
    grams, owner = grams[by], owner[by]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(words.count) + 1))


def size_classes(largest: int) -> np.ndarray:
    """First size of every class up to ``largest``, and one more."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array([*out, int(out[-1] * GROWTH) + 1])


def block_keys(grams: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """List keys of all blocks of all sets, and the set of each key."""
    size = np.diff(bounds)
    low = size_classes(int(size.max(initial=1)))
    own = np.searchsorted(low, size, "right") - 1
    last = low[own.clip(0) + 1] - 1  # largest size in the class
    keys, sets = [], []

    def emit(which: np.ndarray, most: np.ndarray, tag: np.ndarray) -> None:
        blocks = most + most // 6 + 3
        keep = (most > 0) & (size[which] > 0)  # with no difference allowed only equal sets link
        which, blocks, tag, most = which[keep], blocks[keep], tag[keep], most[keep]
        if not len(which):
            return
        n = size[which]
        at = np.repeat(bounds[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        g = grams[at]
        first = np.cumsum(blocks) - blocks
        place = np.repeat(first, n) + (((g >> np.uint64(32)) * np.repeat(blocks, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        digest, filled = np.zeros(int(blocks.sum()), np.uint64), np.zeros(int(blocks.sum()), bool)
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # places rise, as each set is sorted
        digest[place[begins]] = np.add.reduceat(mix(g + np.uint64(1)), begins)
        filled[place[begins]] = True
        # With more filled blocks than allowed differences, a filled one is untouched.
        some = np.bincount(np.repeat(np.arange(len(which)), blocks), filled, len(which)) > most
        listed = filled | ~np.repeat(some, blocks)
        nth = np.arange(len(digest)) - np.repeat(first, blocks)
        label = np.repeat(tag, blocks).astype(np.uint64) * np.uint64(1 << 32) + nth.astype(np.uint64)
        keys.append(mix(digest + mix(label + np.uint64(1)))[listed])
        sets.append(np.repeat(which, blocks)[listed])

    num, den = 100 - percent, 100 + percent
    everyone = np.arange(len(size))
    emit(everyone, 2 * last * num // den, own * 2)
    # Pairs across a class border: the smaller set in class c, the larger in c + 1.
    reach = last * 100 // percent  # largest size that links with this class
    lower = np.flatnonzero((size > 0) & (size * 100 >= (last + 1) * percent))
    emit(lower, (last + reach)[lower] * num // den, own[lower] * 2 + 1)
    below = low[own.clip(0)] - 1  # largest size of the class before
    reach = below * 100 // percent
    upper = np.flatnonzero((size > 0) & (below > 0) & (size <= reach))
    emit(upper, (below + reach)[upper] * num // den, own[upper] * 2 - 1)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(sets)


def _cell_links(grams: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among a bounded number of sets, from their differences to the common part."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    num, den = 100 - percent, 100 + percent
    if n == 2:
        common = len(np.intersect1d(grams[: bounds[1]], grams[bounds[1] :], assume_unique=True))
        apart = size.sum() - 2 * common
        linked = apart * den <= size.sum() * num
        return (np.array([0]), np.array([1])) if linked else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    column, held = np.unique(grams, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    count = np.bincount(held, minlength=len(column))
    usual = count * 2 > n
    apart = size - 2 * np.bincount(owner, usual[held], n) + usual.sum()  # shingles that differ from the common part
    changed = np.where(usual, n - count, count)
    useful = np.flatnonzero(changed > 1)  # a difference of one set alone meets no other
    overlap = np.zeros((n, n), np.float32)
    slot = np.full(len(column), -1, np.int64)
    for at in range(0, len(useful), COLUMNS):
        part = useful[at : at + COLUMNS]
        slot[part] = np.arange(len(part))
        has = np.zeros((n, len(part)), np.float32)
        mine = slot[held] >= 0
        has[owner[mine], slot[held[mine]]] = 1
        flip = usual[part]
        has[:, flip] = 1 - has[:, flip]
        overlap += has @ has.T
        slot[part] = -1
    between = apart[:, None] + apart[None, :] - 2 * overlap.astype(np.int64)
    linked = between * den <= (size[:, None] + size[None, :]) * num
    return np.nonzero(np.triu(linked, 1))


def similar_components(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(rid, id, n_shingles, component_id) of every row.

    Words are lower-cased in A-Z; ``n_shingles`` counts distinct shingles. ``component_id`` is
    the smallest id reachable over links (null ids are passed over). Texts without words, and
    null texts, have no shingles and are alone. Repeated rows are in one component. An empty
    table gives an empty table; other columns are ignored. ``docs`` must be a stored table;
    rid is the place of a row in it. Equal sets are known by 128 bits.
    """
    return keyed_components(docs, size, percent, id_col, text_col).drop("component")


def keyed_components(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64, cell: int = CELL
) -> DataFrame:
    """``similar_components`` with ``component``, a key no two components share; null without shingles.

    ``name_bits`` shortens the sets' first names and ``cell`` the cells; results do not depend on either.
    """
    rows = docs.select(row_ids(docs).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    renamed: list[int] = []

    def sized(texts: pa.Array) -> Iterator[tuple]:
        """Sets of slices of texts with their names: 64 bits that serve as id, and 64 more."""
        for at, part in slices(texts):
            grams, bounds = shingle_sets(Words(part, lower=True), size)
            n = np.diff(bounds)
            names = []
            for key in (7, 0x2545F4914F6CDD1D):
                total = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(mix(grams + np.uint64(key)), out=total[1:])
                names.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)))
            name, check = names[0] >> np.uint64(64 - name_bits), names[1]
            if renamed:
                name = np.where(np.isin(name, np.array(renamed, np.uint64)), mix(check + name), name)
            yield at, grams, bounds, n, name.view(np.int64), check.view(np.int64)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, _, n, digest, check in sized(b.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(n)), b.column(1).slice(at, len(n)), pa.array(n.astype(np.int64)), pa.array(digest, mask=n == 0), pa.array(check)],
                    ["rid", "id", "n", "set_id", "check"],
                )

    while True:
        kinds = [*rows.schema.fields[:2], field("n", "bigint"), field("set_id", "bigint"), field("check", "bigint")]
        indexed = materialize(arrow_map(rows, name, kinds), "set-names")
        folded = indexed.filter("n > 0").groupBy("set_id").agg(
            F.min("id").alias("first_id"), F.min("rid").alias("rid"), (F.min("check") != F.max("check")).alias("clash")
        )
        sets = materialize(folded, "sets")
        # Sets that share 64 bits of their names: none in practice, three among 10**10 sets.
        clash = [r[0] % (1 << 64) for r in sets.filter("clash").select("set_id").collect()]
        if not clash:
            break
        renamed = renamed + clash
        discard(indexed, sets)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, grams, bounds, n, digest, _ in sized(b.column(0)):
                once = np.zeros(len(n), bool)
                once[np.unique(digest, return_index=True)[1]] = True  # equal sets of a slice list their blocks once
                keys, owner = block_keys(grams, bounds, percent)
                listed = once[owner]
                yield pa.RecordBatch.from_arrays([pa.array(keys[listed].view(np.int64)), pa.array(digest[owner[listed]])], ["key", "set_id"])

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First set and member of every list with two sets or more; lists of any length stream through."""
        last_key, pivot, last_set = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, sets_ = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            again = np.zeros(len(key), bool)
            again[1:] = ~new[1:] & (sets_[1:] == sets_[:-1])
            again[0] = not new[0] and sets_[0] == last_set
            starts = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            first = np.where(which >= 0, sets_[starts[which.clip(0)]] if len(starts) else pivot, pivot if pivot is not None else 0).astype(np.int64)
            member = ~new & ~again & (sets_ != first)
            last_key, last_set, pivot = key[-1], sets_[-1], first[-1]
            if member.any():
                pair = np.unique(np.stack([np.concatenate([first[member], first[member]]), np.concatenate([sets_[member], first[member]])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["pivot", "set_id"])

    listed = arrow_map(rows.select("text"), blocks, [field("key", "bigint"), field("set_id", "bigint")])
    lists = listed.repartition("key").sortWithinPartitions("key", "set_id")
    members = materialize(arrow_map(lists, pivots, [field("pivot", "bigint"), field("set_id", "bigint")]).distinct(), "members")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = [packer.compress((t or "").encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["rid", "packed"])

    packed = arrow_map(rows.select("rid", "text"), squeeze, [rows.schema["rid"], field("packed", "binary")])
    wanted = sets.join(members.select("set_id").distinct(), "set_id").select("rid", "set_id")
    texts = materialize(packed.join(wanted, "rid").select("set_id", "packed"), "member-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b) of each cell, and (a, pivot, distance, size) of the sets of groups of several cells."""
        opener = zstandard.ZstdDecompressor()
        for t in _runs_over_batches(batches, "cell"):
            place, set_id = t.column("cell").to_numpy(), t.column("set_id").to_numpy()
            pivot = t.column("pivot").fill_null(0).to_numpy()
            asked = t.column("pivot").is_valid().to_numpy()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            out: list[list[np.ndarray]] = [[], [], [], []]

            def put(*columns: np.ndarray) -> None:
                for have, new in zip(out, columns):
                    have.append(new)

            at = 0
            while at < len(cuts) - 1:  # several whole cells at a time, bounded by rows
                to = at + 1
                while to < len(cuts) - 1 and cuts[to + 1] - cuts[at] <= 2 * CELL:
                    to += 1
                raw = [opener.decompress(x) for x in t.column("packed").slice(cuts[at], cuts[to] - cuts[at]).to_pylist()]
                pieces, ends = [], [np.zeros(1, np.int64)]
                for _, part in slices(pa.array(raw, pa.large_binary()).cast(pa.large_string())):
                    g, edge = shingle_sets(Words(part, lower=True), size)
                    pieces.append(g)
                    ends.append(edge[1:] + ends[-1][-1])
                grams, bounds = np.concatenate(pieces), np.concatenate(ends)
                for k in range(at, to):
                    lo, hi = cuts[k] - cuts[at], cuts[k + 1] - cuts[at]
                    if hi - lo < 2:
                        continue
                    mine, edge = grams[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                    ids = set_id[cuts[k] : cuts[k + 1]]
                    a, b = _cell_links(mine, edge, percent)
                    if len(a):
                        root = _union(hi - lo, a, b)
                        moved = np.flatnonzero(root != np.arange(hi - lo))
                        put(ids[moved], ids[root[moved]], np.full(len(moved), -1), np.zeros(len(moved), np.int64))
                    here = slice(cuts[k], cuts[k + 1])
                    for p in np.unique(pivot[here][asked[here]]):
                        center = int(np.flatnonzero(ids == p)[0])
                        inside = np.isin(mine, mine[edge[center] : edge[center + 1]])
                        n = np.diff(edge)
                        far = n + n[center] - 2 * np.bincount(np.repeat(np.arange(hi - lo), n), inside, hi - lo).astype(np.int64)
                        tell = asked[here] & (pivot[here] == p) & (ids != p)
                        put(ids[tell], np.full(int(tell.sum()), p), far[tell], n[tell])
                at = to
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["a", "b", "far", "n"])

    def compared(spread: DataFrame) -> DataFrame:
        """``spread`` (set_id, cell, pivot) compared within cells."""
        rows_of = spread.join(texts, "set_id").select("cell", "set_id", "packed", "pivot").repartition("cell").sortWithinPartitions("cell", "set_id")
        return arrow_map(rows_of, compare, [field(c, "bigint") for c in ("a", "b", "far", "n")])

    grid = materialize(members.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("g")), "groups")
    asked = F.when(F.col("g") > 1, F.col("pivot")).alias("pivot")
    placed = members.filter("set_id <> pivot").join(grid, "pivot").select(
        "set_id", F.xxhash64("pivot", F.pmod(F.xxhash64("set_id"), F.col("g")).cast("int")).alias("cell"), asked
    )
    copies = grid.select("pivot", "g", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("s")).select(
        F.col("pivot").alias("set_id"), F.xxhash64("pivot", "s").alias("cell"), asked
    )
    first = materialize(compared(placed.unionByName(copies)), "first-answers")
    links = first.filter("far < 0").select("a", "b").distinct()
    answers = first.filter("far >= 0").select(F.col("a").alias("set_id"), F.col("b").alias("pivot"), "far", "n")
    links = materialize(links, "set-links")
    labels = component_labels(links, "a", "b")
    if not answers.isEmpty():
        labels = materialize(labels, "set-labels")
        rest = _block_pairs(answers, labels, percent, cell)
        if rest is not None:
            more = compared(rest).filter("far < 0").select("a", "b")
            tree = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
            links = materialize(more.unionByName(tree).distinct(), "set-links")
            labels = component_labels(links, "a", "b")
    labels = labels.withColumnRenamed("id", "set_id")
    known = sets.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(known.join(smallest, "component").select("set_id", "component_id", "component"), "set-components")
    discard(members, grid, texts, first, links, sets)
    return indexed.select("rid", "id", "n", "set_id").join(named, "set_id", "left").select(
        "rid", F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "component",
    )


def _block_pairs(answers: DataFrame, labels: DataFrame, percent: int, cell: int) -> DataFrame | None:
    """Cells (set_id, cell, pivot) of what the distances to the pivots leave open in large groups; None: nothing.

    ``answers`` is (set_id, pivot, far, n) with the distance to the pivot and the set's size.
    """
    num, den = 100 - percent, 100 + percent
    mine, other = (labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part")) for c in ("set_id", "pivot"))
    known = answers.join(mine, "set_id", "left").join(other, "pivot", "left")
    settled = F.coalesce("set_id_part", "set_id") == F.coalesce("pivot_part", "pivot")
    known = materialize(known.select("pivot", "set_id", "far", "n", settled.alias("settled")), "answers")
    open_groups = known.filter("NOT settled").select("pivot").distinct()
    if open_groups.isEmpty():
        return None
    order = [F.col("far").asc(), F.col("set_id").asc()]
    laid = ranked(known.join(open_groups, "pivot", "left_semi"), order, ["pivot", "settled"], name="nth")
    laid = materialize(laid.withColumn("block", F.floor((F.col("nth") - 1) / F.lit(cell))), "answer-blocks")
    blocks = laid.groupBy("pivot", "settled", "block").agg(
        F.min("far").alias("near"), F.max("far").alias("far"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    x, y = blocks.filter("NOT settled").alias("x"), blocks.alias("y")
    gap = F.greatest(F.col("x.near") - F.col("y.far"), F.col("y.near") - F.col("x.far"), F.lit(0))
    both = (
        x.join(y, F.col("x.pivot") == F.col("y.pivot"))
        .filter(F.col("y.settled") | (F.col("y.block") >= F.col("x.block")))
        .filter(gap * den <= (F.col("x.most") + F.col("y.most")) * num)
        .filter((F.col("x.least") * percent <= F.col("y.most") * 100) & (F.col("y.least") * percent <= F.col("x.most") * 100))
    )
    place = F.xxhash64("x.pivot", "x.block", "y.settled", "y.block").alias("cell")
    sides = [both.select(*[F.col(f"{s}.{c}").alias(c) for c in ("pivot", "settled", "block")], place) for s in ("x", "y")]
    spread = laid.join(sides[0].unionByName(sides[1]).distinct(), ["pivot", "settled", "block"])
    return spread.select("set_id", "cell").distinct().withColumn("pivot", F.lit(None).cast("bigint"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one per component, the first stored row of its smallest id.

    Ids need not be distinct or set: components that share an id keep a row each, null ids come
    last. Rows without shingles (null texts, texts without words) all stay. An empty table gives
    an empty table; all columns come back whatever their names.
    """
    found = keyed_components(docs, size, percent, id_col, text_col)
    mine = found.select("rid", F.col(id_col).alias("id"), "component")
    alone = mine.filter(F.col("component").isNull()).select("rid")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "rid")
    first = mine.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("first")).select("first.rid")
    row = fresh("_rid", docs.columns)
    stays = alone.unionByName(first).withColumnRenamed("rid", row)
    rows = docs.select(*docs.columns, row_ids(docs).alias(row))
    return rows.join(stays, row, "left_semi").select(*docs.columns)
