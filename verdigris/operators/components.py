"""Connected components by contraction.

Each round every vertex points at its lowest-ranked neighbor (itself included), pointers are
followed a few steps, and the edge list is rewritten onto the targets. Ranks are re-hashed
every round, so a constant share of the vertices disappears per round whatever the shape of
the graph (a long path contracts as fast as a star) and the edges shrink with them. Nothing but a row count reaches the driver.

Before the rounds every batch of edges is cut down to a spanning forest of itself where it lies:
the same components with at most as many edges as the batch has vertices, so that a table of
many pairs among few ids is not exchanged.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.session import discard, materialize

register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

FOREST_LINKS = 1 << 20  # links that a task holds at once


def _local_roots(u: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(u):
        ru, rw = root[u], root[w]
        apart = ru != rw
        u, w, ru, rw = u[apart], w[apart], ru[apart], rw[apart]
        np.minimum.at(root, np.maximum(ru, rw), np.minimum(ru, rw))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (vertex, smallest vertex of its part) in place of each run of batches."""
    held: list[np.ndarray] = []

    def cut() -> pa.RecordBatch:
        ends = np.concatenate(held, axis=1)
        held.clear()
        ids, place = np.unique(ends, return_inverse=True)
        u, w = place.reshape(2, -1)
        root = _local_roots(u, w, len(ids))
        inner = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[inner]]), pa.array(ids[inner])], ["u", "w"])

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]))
        if sum(h.shape[1] for h in held) >= FOREST_LINKS:
            yield cut()
    if held:
        yield cut()


def _whole_ids(edges: DataFrame) -> bool:
    return {edges.schema[c].dataType for c in ("u", "w")} == {T.LongType()}


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, target): every vertex with the smallest one of its component; all links in one run."""
    for b in _forest(batches):
        root = np.unique(b.column(0).to_numpy())
        v, target = (np.concatenate([root, b.column(c).to_numpy()]) for c in (1, 0))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(target)], ["v", "target"])


def _spanning(edges: DataFrame) -> DataFrame:
    """Fewer links (u < w) with the same components; ids other than whole numbers stay as they are."""
    if not _whole_ids(edges):
        return edges
    return edges.filter("u IS NOT NULL AND w IS NOT NULL").mapInArrow(_forest, "u bigint, w bigint")


def _lowest_neighbor(edges: DataFrame, turn: int) -> DataFrame:
    """(v, target): the neighbor, or v itself, with the smallest hash this round."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
    both = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("v"), F.col("w").alias("n")),
                F.struct(F.col("w").alias("v"), F.col("u").alias("n")),
            )
        ).alias("e")
    ).select("e.v", "e.n")
    best = both.groupBy("v").agg(F.min_by("n", rank("n")).alias("n"))
    return best.select(
        "v", F.when(rank("n") < rank("v"), F.col("n")).otherwise(F.col("v")).alias("target")
    )


def _jump(step: DataFrame) -> DataFrame:
    """Follow each pointer through its target's pointer."""
    ahead = step.select(F.col("v").alias("target"), F.col("target").alias("further"))
    return step.join(ahead, "target").select("v", F.col("further").alias("target"))


def component_labels(edges: DataFrame, a: str = "account_id_1", b: str = "account_id_2", jumps: int = 2) -> DataFrame:
    """(id, component) for every id with an edge; component = smallest id in it."""
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")).filter(F.col("u") != F.col("w"))
    current = materialize(_spanning(links).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while n_links := current.count():
        if n_links <= FOREST_LINKS and _whole_ids(current):
            steps.append(materialize(current.coalesce(1).mapInArrow(_labels, "v bigint, target bigint"), "cc-step"))
            break
        near = materialize(_lowest_neighbor(current, len(steps) + 1), "cc-step")
        step = near
        for _ in range(jumps):
            step = _jump(step)
        step = materialize(step, "cc-step")
        discard(near)
        steps.append(step)
        to_u = step.select(F.col("v").alias("u"), F.col("target").alias("tu"))
        to_w = step.select(F.col("v").alias("w"), F.col("target").alias("tw"))
        before, current = current, materialize(
            current.join(to_u, "u")
            .join(to_w, "w")
            .filter(F.col("tu") != F.col("tw"))
            .select(F.least("tu", "tw").alias("u"), F.greatest("tu", "tw").alias("w"))
            .distinct(),
            "cc-edges",
        )
        discard(before)
    if not steps:
        nothing = current.filter(F.lit(False))
        return nothing.select(F.col("u").alias("id"), F.col("u").alias("component"))
    # Later rounds hold ever fewer vertices, so compose from the last one back.
    owner = steps[-1].select(F.col("v").alias("id"), F.col("target").alias("root"))
    for step in reversed(steps[:-1]):
        later = owner.select(F.col("id").alias("target"), F.col("root").alias("deeper"))
        owner = step.join(later, "target", "left").select(
            F.col("v").alias("id"), F.coalesce("deeper", "target").alias("root")
        )
    owner = materialize(owner, "cc-owner")
    discard(current, *steps)
    names = owner.groupBy("root").agg(F.min("id").alias("component"))
    return owner.join(names, "root").select("id", "component")


def account_components(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """(account_id, component, component_size); isolated accounts are their own component."""
    labels = component_labels(edges).withColumnRenamed("id", "account_id")
    out = accounts.select("account_id").join(labels, "account_id", "left")
    out = out.select("account_id", F.coalesce("component", "account_id").alias("component"))
    sizes = out.groupBy("component").agg(F.count("*").alias("component_size"))
    return out.join(sizes, "component").select("account_id", "component", "component_size")
