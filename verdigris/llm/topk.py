"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ranked by length and cut into buckets, longest first. The first bucket gives every
query a score that its k-th best cannot fall below. A bucket whose longest vector cannot reach
that score is skipped, queries in blocks. In the buckets left, the score over both lengths is a
local cosine threshold: where it is high, only vectors whose largest query coordinates fit the
threshold are kept, where it is low, only vectors that are long enough; products of the
vectors kept are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.arrow import arrow_map, field, good_vectors, groups
from verdigris.llm.sharding import numbered
from verdigris.session import materialize

BUCKET, BLOCK = 2048, 256
LONGEST = 3.03e9  # a score is at most the product of two lengths, which stays below 2**63
STEEP = 0.7
FOCUS = 3


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, ints, norm): floor(scale * x) of every usable vector, and its length.

    Vectors of length LONGEST or more are left out: two of them can have a score beyond 64 bits.
    """
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, good = good_vectors(b.column(1))
            ints, norms, short = [], [], []
            for x in good:
                with np.errstate(over="ignore"):
                    q = np.floor(scale * x.astype(np.float64))
                    length = float(np.sqrt((q * q).sum()))
                short.append(length < LONGEST)
                if short[-1]:
                    ints.append(q.astype("<i8").tobytes())
                    norms.append(length)
            keep[keep] = short
            ids = b.column(0).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ints, pa.binary()), pa.array(norms, pa.float64())], ["id", "ints", "norm"])

    return arrow_map(narrow, pack, [narrow.schema["id"], field("ints", "binary"), field("norm", "double")])


def _padded(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), "<i8").reshape(len(values), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where all sums stay below 2**53, else modulo 2**64, which a score fits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, <id>, score): the k best candidates of every query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own. Ties go to the smaller id (null last); fewer candidates give fewer rows. Null
    vectors and vectors with null or non-finite components take no part, nor do those whose
    quantized length is LONGEST or more (one component of some 11.8 million); a shorter vector
    counts as padded with zeros. Repeated rows are candidates and queries of their own. An
    empty table gives an empty table; other columns are ignored.
    """
    stored = materialize(quantized(vectors, scale, id_col, vector_col).withColumn("short", -F.col("norm")), "ints")
    rows, n = numbered(stored, ["short", "id"], "place")
    rows = materialize(rows.withColumn("bucket", F.floor(F.col("place") / F.lit(BUCKET)).cast("long")), "bucketed")
    asked, n_asked = numbered(rows.filter(F.pmod("id", F.lit(every)) == 0).select("id", "place", "ints", "norm"), ["place"], "nth")
    asked = materialize(asked.withColumn("block", F.floor(F.col("nth") / F.lit(BLOCK)).cast("long")), "asked")
    longest = rows.groupBy("bucket").agg(F.max("norm").alias("longest"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "cell"):
            found = _cell(g, k)
            if found:
                query, qid, ids, place, score = zip(*found)
                kind = g.schema.field("id").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(qid, kind), pa.array(ids, kind), pa.array(place, pa.int64()), pa.array(score, pa.int64())],
                    ["query", "query_id", "id", "place", "score"],
                )

    id_kind = stored.schema["id"].dataType.simpleString()
    schema = [field("query", "bigint"), field("query_id", id_kind), field("id", id_kind), field("place", "bigint"), field("score", "bigint")]
    last_block, last_bucket = -(-n_asked // BLOCK) - 1, -(-n // BUCKET) - 1
    spark = vectors.sparkSession
    blocks = spark.range(last_block + 1).select(F.col("id").alias("block"))
    first = materialize(_compared(blocks.withColumn("bucket", F.lit(0).cast("long")), asked, None, rows, best, schema), "first")
    floors = first.groupBy("query").agg(F.min("score").alias("low"), F.count("*").alias("have"))
    floors = floors.select(F.col("query").alias("place"), F.when(F.col("have") >= k, F.col("low")).alias("floor"))
    asked = materialize(asked.join(floors, "place", "left"), "floors")
    reach = asked.groupBy("block").agg(F.min(F.when(F.col("norm") > 0, F.coalesce(F.col("floor") / F.col("norm"), F.lit(float("-inf")))).otherwise(F.lit(float("-inf")))).alias("reach"))
    rest = reach.filter(F.lit(last_bucket) >= 1).select("block", "reach", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(1, last_bucket)).cast("long"))).alias("bucket"))
    rest = rest.join(longest, "bucket").filter(F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("block", "bucket")
    more = _compared(rest, asked, "floor", rows, best, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("place"))
    every_found = first.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return every_found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _compared(blocks: DataFrame, asked: DataFrame, floor: str | None, rows: DataFrame, best, schema) -> DataFrame:
    """Compare query blocks with candidate buckets, cell by cell."""
    cell = F.xxhash64("block", "bucket").alias("cell")
    low = F.col(floor) if floor else F.lit(None).cast("bigint")
    q = blocks.join(asked, "block").select(cell, F.lit(True).alias("query"), "id", "place", "ints", "norm", low.alias("floor"))
    c = blocks.join(rows, "bucket").select(cell, F.lit(False).alias("query"), "id", "place", "ints", "norm", F.lit(None).cast("bigint").alias("floor"))
    cells = q.unionByName(c).repartition("cell").sortWithinPartitions("cell", "query", "place")
    return arrow_map(cells, best, schema)


def _cell(g: pa.Table, k: int) -> list[tuple]:
    is_query = g.column("query").to_numpy(zero_copy_only=False)
    values = g.column("ints").to_pylist()
    width = max(map(len, values))
    ints = _padded(values, width)
    norm, place, ids = g.column("norm").to_numpy(), g.column("place").to_numpy(), g.column("id").to_pylist()
    floors = g.column("floor").to_pylist()
    cand, asks = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    if not len(cand) or not len(asks):
        return []
    x, lengths = ints[cand], norm[cand]  # longest first
    unit = x / np.maximum(lengths, 1e-300)[:, None]
    id_rank = np.empty(len(cand), np.int64)
    id_rank[sorted(range(len(cand)), key=lambda i: (ids[cand[i]] is None, ids[cand[i]] if ids[cand[i]] is not None else 0))] = np.arange(len(cand))
    out: list[tuple] = []
    whole: list[tuple[int, int]] = []  # queries that need the length prune only
    for a in asks:
        need = floors[a]
        if need is None or norm[a] == 0:
            whole.append((a, len(cand)))
            continue
        at_least = need / norm[a] - 1e-6
        n = len(cand) if at_least <= 0 else int(np.searchsorted(-lengths, -at_least * (1 - 1e-9), "right"))
        if not n:
            continue
        local = need / (norm[a] * lengths[0])
        if local < STEEP:
            whole.append((a, n))
            continue
        q = ints[a] / norm[a]
        keep = np.ones(n, bool)
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            low, high = _feasible(q[f], local)
            keep &= (unit[:n, f] >= low) & (unit[:n, f] <= high)
        _best(out, a, np.flatnonzero(keep), _products(ints[a][None], x[:n][keep])[0], k, place, ids, cand, id_rank)
    if whole:
        n = max(m for _, m in whole)
        rows = np.array([a for a, _ in whole])
        scores = _products(ints[rows], x[:n])
        for (a, m), s in zip(whole, scores):
            _best(out, a, np.arange(m), s[:m], k, place, ids, cand, id_rank)
    return out


def _feasible(q: float, cosine: float) -> tuple[float, float]:
    """Values one coordinate of a unit vector can take if its cosine to the query is at least
    ``cosine`` and the query's coordinate is ``q``: the arc around the query's own angle."""
    own, arc = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    low, high = np.cos(min(np.pi, own + arc)), np.cos(max(0.0, own - arc))
    return low - 1e-9, high + 1e-9


def _best(out, a, among, scores, k, place, ids, cand, id_rank) -> None:
    own = place[cand[among]] != place[a]
    among, scores = among[own], scores[own]
    if len(scores) > k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        top = scores >= low
        among, scores = among[top], scores[top]
    for i in np.lexsort((id_rank[among], -scores))[:k]:
        c = cand[among[i]]
        out.append((int(place[a]), ids[a], ids[c], int(place[c]), int(scores[i])))
