"""Merkle manifest of a table: a tree per source over its rows, and one over the sources.

Leaf coordinates come from a bitmap-rank index: compressed bitmaps of ids per (source, bucket)
are built where the rows lie and merged; running sums over the containers' popcounts are the
upper directory, a rank query in a container gives the rest. Rows are never sorted by id: a row
finds its coordinate beside its container.

Levels then shrink by keyed slot arrays: coordinate c is slot c mod ``fan`` of the array keyed
(source, c div fan), and an array's digests in slot order make the node above. The arrays of
every level are stored once and joined downwards for the proofs, so what moves per leaf is
a share of 1 / ``fan`` of its path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.running import ranked, running_sums
from verdigris.llm import doc_bitmaps
from verdigris.llm.arrow import arrow_map, field
from verdigris.session import discard, materialize

FAN = 16
CROWD = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, each ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _grouped(source: Column) -> Column:
    """A text per source that is never null and sorts nulls first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (group, id, leaf, ...) with ``at``, the place of a row in its group, and ``n``, the group's rows.

    Rows ascend by id, null ids first; rows of one id by leaf. ``leaves`` must be a stored table.
    """
    named = leaves.filter("id IS NOT NULL")
    parts = arrow_map(named.select("group", "id"), doc_bitmaps.build, [field(*c) for c in doc_bitmaps.COLUMNS])
    merged = arrow_map(parts.repartition("group", "bucket").sortWithinPartitions("group", "bucket"), doc_bitmaps.merge, parts.schema)
    bitmaps = materialize(merged, "bitmaps")
    totals = materialize(leaves.groupBy("group").agg(F.count("*").alias("total"), F.count_if(F.col("id").isNull()).alias("unnamed")), "manifest-groups")
    directory = running_sums(bitmaps, [F.col("bucket").asc()], {"upto": F.col("n")}, ["group"]).join(totals, "group")
    directory = materialize(directory.withColumn("base", F.col("upto") - F.col("n") + F.col("unnamed")), "bitmap-directory")

    # A bucket of many rows (ids that repeat) is cut into slices, its container copied to each.
    crowded = directory.filter(F.col("n") > CROWD).select("group", "bucket", F.ceil(F.col("n") / F.lit(CROWD)).cast("int").alias("slices"))
    payload = [c for c in leaves.columns if c not in ("group", "id")]
    rows = named.withColumn("bucket", F.shiftright("id", 16))
    index = directory
    if crowded.isEmpty():
        rows, index = rows.withColumn("slice", F.lit(0)), index.withColumn("slice", F.lit(0))
    else:
        rows = rows.join(crowded, ["group", "bucket"], "left").withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.coalesce("slices", F.lit(1))).cast("int"))
        index = index.join(crowded, ["group", "bucket"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    inside = ["ids", "again", "more", "base", "total"]
    index = index.select("group", "bucket", "slice", F.lit(0).alias("row"), *inside, F.lit(None).cast(leaves.schema["id"].dataType).alias("id"), *[F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in payload])
    rows = rows.select("group", "bucket", "slice", F.lit(1).alias("row"), *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in inside], "id", *payload)
    beside = index.unionByName(rows).repartition("group", "bucket", "slice").sortWithinPartitions("group", "bucket", "slice", "row")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every container comes right before its rows, which may go on over any number of batches."""
        ranks, base, total = None, 0, 0
        for b in batches:
            is_row = b.column(3).to_numpy() == 1
            low = b.column(9).fill_null(0).to_numpy() & (doc_bitmaps.WIDTH - 1)
            at, n, many = (np.zeros(b.num_rows, t) for t in (np.int64, np.int64, bool))
            heads = np.flatnonzero(~is_row)
            for a, z in zip([-1, *heads], [*heads, b.num_rows]):
                if a >= 0:
                    ranks = doc_bitmaps.Ranks(*(b.column(k)[int(a)].as_py() for k in (4, 5, 6)))
                    base, total = b.column(7)[int(a)].as_py(), b.column(8)[int(a)].as_py()
                for lo in range(a + 1, z, 4096):
                    hi = min(z, lo + 4096)
                    at[lo:hi] = ranks.rank(low[lo:hi]) + base
                    many[lo:hi] = ranks.repeated(low[lo:hi])
                n[a + 1 : z] = total
            keep = pa.array(is_row)
            yield pa.RecordBatch.from_arrays(
                [c.filter(keep) for c in (b.column(0), *b.columns[9:], pa.array(at), pa.array(n), pa.array(many))], names
            )

    names = ["group", "id", *payload, "at", "n", "many"]
    schema = [leaves.schema["group"], leaves.schema["id"], *[leaves.schema[c] for c in payload], *map(field, names[-3:], ["bigint", "bigint", "boolean"])]
    found = materialize(arrow_map(beside, locate, schema), "manifest-leaves")
    out = found.filter("NOT many").drop("many")
    # Rows of one id, and rows without: their order is that of the leaves.
    rest = found.filter("many").drop("many").unionByName(
        leaves.filter("id IS NULL").join(totals, "group").select("group", "id", *payload, F.lit(0).cast("long").alias("at"), F.col("total").alias("n"))
    )
    if not rest.isEmpty():
        rest = materialize(rest, "manifest-ties").withColumn("_tie", F.monotonically_increasing_id())
        tied = ranked(rest, [F.col("leaf").asc(), F.col("_tie").asc()], ["group", "at"], name="_nth")
        out = out.unionByName(tied.withColumn("at", F.col("at") + F.col("_nth") - 1).select(*out.columns))
        out = materialize(out, "manifest-leaves")
        discard(found)
    discard(bitmaps, directory)
    return out


def _slots(nodes: DataFrame, *also: str) -> DataFrame:
    """One row per array: its nodes (at most FAN) in slot order."""
    slot = F.struct(F.pmod("at", F.lit(FAN)).cast("int").alias("slot"), "digest", *also)
    return nodes.groupBy("group", F.shiftright("at", 4).alias("at")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(slot)).alias("slots")
    )


def _more(level: int) -> Column:
    """Whether a group of ``n`` leaves has more than one node at ``level``."""
    return F.shiftright(F.col("n") - 1, 4 * level) > 0


def _joined_digests(slots: Column) -> Column:
    return F.sha2(F.array_join(F.transform(slots, lambda s: s["digest"]), ""), 256)


def _levels(nodes: DataFrame, *also: str) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of every level of all trees (group, n, at, digest), and the trees' roots."""
    height = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, level = [], nodes.filter(~_more(0)).select("group", "n", "digest"), 0
    while (height - 1) >> 4 * level > 0:
        stored = materialize(_slots(nodes.filter(_more(level)), *(also if level == 0 else ())), "manifest-level")
        levels.append(stored)
        level += 1
        nodes = stored.select("group", "n", "at", _joined_digests(F.col("slots")).alias("digest"))
        roots = roots.unionByName(nodes.filter(~_more(level)).select("group", "n", "digest"))
    return levels, roots


def _opened(level: DataFrame, above: DataFrame, *also: str) -> DataFrame:
    """(group, at, path, digest) of the nodes in the arrays of ``level`` below the paths of ``above``.

    Further columns of ``above`` pass to the nodes; ``also`` are the nodes' own.
    """
    j = level.join(above, ["group", "at"]).select("*", F.explode("slots").alias("me"))

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("slots", lambda s: keep(s["slot"], F.col("me.slot"))), lambda s: s["digest"]), "")

    step = F.struct(side(lambda s, me: s < me).alias("left"), side(lambda s, me: s > me).alias("right"))
    passed = [c for c in above.columns if c not in ("group", "at", "path")]
    return j.select(
        "group", (F.col("at") * FAN + F.col("me.slot")).alias("at"), F.concat(F.array(step), F.col("path")).alias("path"),
        F.col("me.digest").alias("digest"), *passed, *[F.col(f"me.{c}").alias(c) for c in also]
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, leaf: Column, source: Column, id_col: Column, carry: dict[str, Column]) -> DataFrame:
    """(id, leaf, subroot, root, path, carried columns) of every row.

    ``leaf`` is a row's digest. Per source, leaves ascend by id (null ids first, rows of one id
    by leaf); while several nodes remain, every FAN consecutive ones become the digest of their
    joined digests. What remains is the source's subroot; subroots in order of their sources
    (null first, then by bytes) give the root alike. ``path`` holds the joined digests left and
    right of a node in its run, from the leaf up. Equal rows have places of their own. A source
    of one row has its leaf for subroot. An empty table gives an empty table.
    """
    also = ["id", *carry]
    leaves = materialize(docs.select(_grouped(source).alias("group"), id_col.cast("long").alias("id"), leaf.alias("leaf"), *[c.alias(k) for k, c in carry.items()]), "leaves")
    nodes = coordinates(leaves).withColumnRenamed("leaf", "digest")
    levels, subroots = _levels(nodes, *also)
    subroots = materialize(subroots.withColumnRenamed("n", "leaves"), "subroots")
    upper = ranked(subroots, [F.col("group").asc()], name="nth").select(
        F.lit("").alias("group"), (F.col("nth") - 1).alias("at"), F.lit(subroots.count()).cast("long").alias("n"), "digest", F.col("group").alias("name"), "leaves"
    )
    upper = materialize(upper, "subroots")
    top_levels, root = _levels(upper, "name", "leaves")
    top = root.first()

    # Paths of the subroots, then level by level down every source's tree.
    nowhere = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    if top_levels:
        above = root.select("group", F.lit(0).cast("long").alias("at"), nowhere)
        for k in range(len(top_levels) - 1, 0, -1):
            above = _opened(top_levels[k], above).drop("digest")
        above = _opened(top_levels[0], above, "name", "leaves")
    else:
        above = upper.select("*", nowhere)
    tops = above.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), F.col("leaves").alias("n"))
    tops = materialize(tops, "subroot-paths")

    def start(level: int) -> DataFrame:
        """Subroots that are reached at ``level`` of their tree."""
        reached = ~_more(level) if level == 0 else ~_more(level) & _more(level - 1)
        return tops.filter(reached).drop("n")

    above = start(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        above = _opened(levels[k], above).drop("digest").unionByName(start(k))
    lone = nodes.filter(~_more(0)).select("group", "digest", *also).join(start(0), "group")
    rows = _opened(levels[0], above, *also).unionByName(lone) if levels else lone
    return rows.select("id", F.col("digest").alias("leaf"), "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"), "path", *carry)


def document_manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; see ``manifest``.

    Rows where ``tampered`` holds are folded again from a leaf whose text has A-Z lower-cased:
    by default those whose decimal id has a CRC-32 divisible by 5, null ids never. A null text
    stays null. ``verified`` says whether the folded root is the manifest's.
    """
    if tampered is None:
        tampered = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    lowered = [F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in fields]
    carry = {"shown": F.when(tampered, digest_of(*lowered))}
    rows = manifest(docs, digest_of(*map(F.col, fields)), F.col(source_col), F.col(id_col), carry)
    done = rows.select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("shown", "leaf"), F.col("path")).alias("folded_root"),
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
