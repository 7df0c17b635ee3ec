"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Normalized vectors at cosine c are sqrt(2 - 2c) apart. A table's key is a tuple of quantized
Gaussian projections; close vectors share a key in some table. Equal vectors are folded first,
so a vector that a third of all rows repeat counts as one with a multiplicity. Buckets are cut
into a grid of bounded cells, each cell compares its vectors as one matrix product and reports
counts per vector and a spanning forest, never pairs. A pair is counted in the first table
that holds it, which both vectors' keys tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.arrow import arrow_map, field, good_vectors, groups, matrix, row_ids
from verdigris.operators.components import component_labels
from verdigris.session import materialize

CELL = 512
WIDTH = 1.5
STRANGERS = 20
RECALL = 0.95
SEED = 7


def _same_key(distance: float, width: float) -> float:
    """Chance that one quantized projection agrees at a distance."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_shape(n: int, threshold: float, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Projections per key and tables for n vectors: about STRANGERS unrelated vectors in a
    bucket, and ``recall`` for pairs exactly at the threshold (more above it)."""
    near, far = _same_key(math.sqrt(2 - 2 * threshold), width), _same_key(math.sqrt(2), width)
    k = max(4, round(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected place of each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Links are pairs of rows at cosine >= threshold (double precision); found pairs are exact,
    and ``table_shape`` bounds how many are missed. Null and zero vectors, and vectors with
    null or non-finite components, link with nothing; neither do vectors of other lengths.
    ``component_id`` is the smallest id reachable by links. Repeated rows count each; a row
    with a null id links like any other. An empty table gives an empty table; other columns
    are ignored. ``vectors`` must be a stored table.
    """
    spark = vectors.sparkSession
    narrow = vectors.select(row_ids(vectors).alias("rid"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, good = good_vectors(b.column(2))
            packed: list[bytes | None] = [None] * b.num_rows
            for row, x in zip(np.flatnonzero(keep), good):
                x = x.astype(np.float64)
                if x.any():
                    packed[row] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(packed, pa.binary())], ["rid", "id", "vec"])

    packed = materialize(arrow_map(narrow, pack, [*narrow.schema.fields[:2], field("vec", "binary")]), "vectors")
    n = packed.count()
    k, tables = table_shape(n, threshold)

    classes = packed.filter(F.col("vec").isNotNull()).groupBy("vec").agg(
        F.min("rid").alias("cid"), F.count("*").alias("copies"), F.min("id").alias("first_id")
    )

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for b in batches:
            rows = b.column(0).to_pylist()
            codes = np.zeros((len(rows), tables), np.int32)
            sizes = np.array([len(r) // 8 for r in rows])
            for d in np.unique(sizes):
                if d not in planes:
                    rng = np.random.default_rng([seed, int(d)])
                    planes[d] = rng.standard_normal((d, tables * k)), rng.random(tables * k) * WIDTH, rng.integers(1, 1 << 62, k) | 1
                a, shift, spread = planes[d]
                at = np.flatnonzero(sizes == d)
                x = np.frombuffer(b"".join(rows[i] for i in at), np.float64).reshape(len(at), d)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cells = np.floor((x @ a + shift) / WIDTH).astype(np.int64).reshape(len(at), tables, k)
                mixed = (cells * spread).sum(axis=2, dtype=np.int64) + int(d)
                codes[at] = (mixed ^ (mixed >> 31)).astype(np.int32)
            stored = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, stored, pa.array(list(codes), pa.list_(pa.int32()))], ["vec", "cid", "copies", "first_id", "codes", "keys"])

    keyed = materialize(
        arrow_map(classes, keys, [*classes.schema.fields, field("codes", "binary"), field("keys", "array<int>")]), "keyed"
    )
    rows = keyed.select("cid", F.posexplode("keys").alias("t", "code"))
    buckets = rows.groupBy("t", "code").count().filter("count > 1")
    grid = F.ceil(F.col("count") / F.lit(CELL)).cast("int")
    placed = rows.join(buckets, ["t", "code"]).withColumn("g", grid)
    placed = placed.withColumn("s", F.pmod(F.xxhash64("cid"), F.col("g")).cast("int"))
    # Slice s meets every slice: as the first one in cells (s, j >= s), as the second in (i < s, s).
    spread = placed.select("cid", "t", "code", "s", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    spread = spread.select(
        "cid", "t", F.xxhash64("t", "code", F.least("s", "o"), F.greatest("s", "o")).alias("cell"), (F.least("s", "o") == F.greatest("s", "o")).alias("whole"), (F.col("s") <= F.col("o")).alias("left")
    )
    cells = spread.join(keyed.select("cid", "vec", "codes", "copies"), "cid").repartition("cell").sortWithinPartitions("cell", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cell"):
            for part in _same_length(g):
                if part.num_rows < 2:
                    continue
                found = _cell(part, threshold)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["cid", "links", "root"])

    ordered = cells.select("cell", "cid", "t", "whole", "left", "vec", "codes", "copies")
    found = materialize(arrow_map(ordered, compare, [field(c, "bigint") for c in ("cid", "links", "root")]), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("others"))
    labels = component_labels(found.filter("cid != root").select("cid", "root").distinct(), "cid", "root")
    parts = keyed.select("cid", "copies", "first_id").join(links, "cid", "left").join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    parts = parts.withColumn("component", F.coalesce("component", "cid"))
    smallest = parts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = parts.join(smallest, "component").select("cid", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    member = packed.join(keyed.select("cid", "vec"), "vec", "left").join(known, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return member.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _same_length(group: pa.Table) -> list[pa.Table]:
    sizes = np.array([len(v.as_py()) for v in group.column("vec")])
    if (sizes == sizes[0]).all():
        return [group]
    return [group.filter(pa.array(sizes == s)) for s in np.unique(sizes)]


def _cell(part: pa.Table, threshold: float):
    """Counts of links first seen in this table, and each linked vector's root in the cell."""
    x = matrix(part.column("vec"), "<f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    left = part.column("left").to_numpy()
    if not part.column("whole")[0].as_py():
        across = left[a] != left[b]
        a, b = a[across], b[across]
    if not len(a):
        return None
    t = part.column("t")[0].as_py()
    codes = matrix(part.column("codes"), "<i4")
    cid, copies = part.column("cid").to_numpy(), part.column("copies").to_numpy()
    counts = np.zeros(len(x), np.int64)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        fresh = ~(codes[i, :t] == codes[j, :t]).any(axis=1)
        counts += np.bincount(i[fresh], copies[j[fresh]], len(x)).astype(np.int64)
        counts += np.bincount(j[fresh], copies[i[fresh]], len(x)).astype(np.int64)
    root = _union(len(x), a, b)
    linked = np.zeros(len(x), bool)
    linked[a] = linked[b] = True
    return cid[linked], counts[linked], cid[root[linked]]
