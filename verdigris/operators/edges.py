"""Weighted account-to-account edges from shared identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import EDGE_WEIGHTS, IDENTITY_EDGE, IDENTITY_WINDOW_US, IP_WINDOW_US, RARE_COUPON_ROWS
from verdigris.functions.exprs import lookup, micros, nonblank
from verdigris.operators.bandjoin import close_pairs
from verdigris.operators.identity import ip_meetings, ip_pairs
from verdigris.session import materialize


def canonical_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Smaller id first; self pairs dropped."""
    return df.filter(F.col(a) != F.col(b)).withColumns(
        {"account_id_1": F.least(a, b), "account_id_2": F.greatest(a, b)}
    )


def _typed(pairs: DataFrame, edge_type: F.Column) -> DataFrame:
    return pairs.select(
        F.col("id_1").alias("account_id_1"), F.col("id_2").alias("account_id_2"), edge_type.alias("edge_type")
    )


def identity_edges(orders: DataFrame, window_us: int = IDENTITY_WINDOW_US) -> DataFrame:
    """Pairs that used one device, address, phone or instrument within the window."""
    items = F.array(
        *[
            F.struct(F.lit(t).alias("edge_type"), F.col(c).cast("string").alias("entity"))
            for c, t in IDENTITY_EDGE.items()
        ]
    )
    events = orders.select(
        "account_id", micros("order_timestamp").alias("t"), F.explode(items).alias("e")
    ).select("account_id", "t", "e.*")
    pairs = close_pairs(events, ["edge_type", "entity"], "account_id", "t", window_us)
    return _typed(pairs, F.col("edge_type")).distinct()


def ip_edges(orders: DataFrame, devices: DataFrame, window_us: int = IP_WINDOW_US) -> DataFrame:
    return _typed(ip_pairs(orders, devices, window_us), F.lit("shares_ip_prefix"))


def coupon_edges(orders: DataFrame, below: int = RARE_COUPON_ROWS) -> DataFrame:
    """Pairs that used one rare coupon code. A kept code has fewer than ``below`` users."""
    uses = (
        orders.filter(nonblank("coupon_code"))
        .groupBy("coupon_code", "account_id")
        .agg(F.count("*").alias("uses"))
    )
    rare = (
        uses.groupBy("coupon_code").agg(F.sum("uses").alias("rows")).filter(F.col("rows") < below)
    )
    users = uses.join(rare.select("coupon_code"), "coupon_code", "left_semi")
    left = users.select("coupon_code", F.col("account_id").alias("id_1"))
    right = users.select("coupon_code", F.col("account_id").alias("id_2"))
    pairs = left.join(right, "coupon_code").filter(F.col("id_1") < F.col("id_2"))
    return _typed(pairs.select("id_1", "id_2").distinct(), F.lit("shares_coupon"))


def raw_edges(orders: DataFrame, devices: DataFrame) -> DataFrame:
    """All evidence, one row per pair and type."""
    return reduce(
        DataFrame.unionByName,
        [identity_edges(orders), ip_edges(orders, devices), coupon_edges(orders)],
    )


def raw_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("edge_type").agg(F.count("*").alias("candidate_edges"))


def merge_evidence(raw: DataFrame) -> DataFrame:
    """One row per pair: top weight, its type (name breaks ties), all types."""
    weighted = raw.withColumn("weight", lookup(F.col("edge_type"), EDGE_WEIGHTS))
    return weighted.groupBy("account_id_1", "account_id_2").agg(
        F.min_by("edge_type", F.struct(-F.col("weight"), F.col("edge_type"))).alias("edge_type"),
        F.max("weight").alias("weight"),
        F.array_sort(F.collect_set("edge_type")).alias("edge_types"),
    )


def final_edges(orders: DataFrame, devices: DataFrame) -> DataFrame:
    """``merge_evidence`` of ``raw_edges`` without the list of types.

    Pairs known by an IP prefix alone, which are nearly all of a large table, are written where
    they are met; only pairs with more evidence are brought together.
    """
    small = materialize(identity_edges(orders).unionByName(coupon_edges(orders)), "small-evidence")
    known = small.select(F.col("account_id_1").alias("id_1"), F.col("account_id_2").alias("id_2")).distinct()
    once, again = ip_meetings(orders, devices, known=known)
    ip = F.lit("shares_ip_prefix")
    merged = merge_evidence(small.unionByName(_typed(again.distinct(), ip))).select("account_id_1", "account_id_2", "edge_type", "weight")
    alone = _typed(once, ip).withColumn("weight", F.lit(EDGE_WEIGHTS["shares_ip_prefix"]))
    return alone.unionByName(merged)


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Output order by pair (a range-partitioned sort)."""
    return edges.orderBy("account_id_1", "account_id_2")


def edge_violations(edges: DataFrame) -> DataFrame:
    """One row of violation counts and counts by type."""
    allowed = sorted(set(EDGE_WEIGHTS.values()))
    pair = edges.groupBy(
        F.least("account_id_1", "account_id_2").alias("p1"),
        F.greatest("account_id_1", "account_id_2").alias("p2"),
    ).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("weight").isin(allowed)).alias("bad"),
        *[F.count_if(F.col("edge_type") == t).alias(t) for t in EDGE_WEIGHTS],
    )
    return pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum(F.when(F.col("p1") == F.col("p2"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pairs"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_weights"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(f"n_{t}") for t in EDGE_WEIGHTS],
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """Each undirected edge as two rows (src, dst, edge_type, weight), one pass over the edges."""
    ways = F.array(
        F.struct(F.col("account_id_1").alias("src"), F.col("account_id_2").alias("dst")),
        F.struct(F.col("account_id_2").alias("src"), F.col("account_id_1").alias("dst")),
    )
    return edges.select(F.explode(ways).alias("w"), "edge_type", "weight").select(
        "w.src", "w.dst", "edge_type", "weight"
    )


def vertices(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """Every account with its degree; isolated accounts stay with 0."""
    degree = both_directions(edges).groupBy("src").agg(F.count("*").alias("degree"))
    return accounts.select("account_id").join(
        degree.withColumnRenamed("src", "account_id"), "account_id", "left"
    ).select("account_id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))
