"""Community and neighbor aggregates, contextual flags, checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.edges import both_directions

COMMUNITY_AGGREGATES = {
    "community_size": F.count,
    "community_return_rate": F.avg,
    "community_refund_rate": F.avg,
    "community_avg_order_value": F.avg,
    "community_dispute_rate": F.avg,
    "community_coupon_usage": F.avg,
    "community_total_orders": F.sum,
    "community_max_return_rate": F.max,
}
_SOURCE = {
    "community_size": "account_id",
    "community_return_rate": "return_rate",
    "community_refund_rate": "refund_rate",
    "community_avg_order_value": "avg_order_value",
    "community_dispute_rate": "dispute_rate",
    "community_coupon_usage": "coupon_usage_rate",
    "community_total_orders": "total_orders",
    "community_max_return_rate": "return_rate",
}


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def join_contract(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: keys repeated on either side, keys of the left without a partner."""
    key = F.lit(1).alias("one")
    a = duplicate_keys(left, on).agg(F.count("*").alias("left_duplicates")).select("*", key)
    b = duplicate_keys(right, on).agg(F.count("*").alias("right_duplicates")).select("*", key)
    c = (
        left.select(*on).distinct().join(right.select(*on), on, "left_anti")
        .agg(F.count("*").alias("left_without_match")).select("*", key)
    )
    return a.join(b, "one").join(c, "one").drop("one")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """Join after checking that the sides named ``one`` have unique keys."""
    left_one, right_one = (side == "one" for side in validate.split("_to_"))
    for name, df, must in (("left", left, left_one), ("right", right, right_one)):
        if must and not duplicate_keys(df, on).isEmpty():
            raise ValueError(f"{validate} join on {on}: the {name} side has repeated keys")
    return left.join(right, on, how)


def community_features(features: DataFrame, communities: DataFrame) -> DataFrame:
    """Per account: aggregates of its community (aggregate, then join back)."""
    labelled = features.join(communities, "account_id")
    per = labelled.groupBy("community_id").agg(
        *[f(_SOURCE[n]).alias(n) for n, f in COMMUNITY_AGGREGATES.items()]
    )
    return communities.join(per, "community_id").select(
        "account_id", "community_id", *COMMUNITY_AGGREGATES
    )


def neighbor_return_rates(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean return rate of graph neighbors; 0 for isolated accounts."""
    rates = features.select(F.col("account_id").alias("dst"), "return_rate")
    per = (
        both_directions(edges).select("src", "dst").join(rates, "dst")
        .groupBy("src").agg(F.avg("return_rate").alias("r"))
    )
    return features.select("account_id").join(
        per.withColumnRenamed("src", "account_id"), "account_id", "left"
    ).select("account_id", F.coalesce("r", F.lit(0.0)).alias("neighbor_avg_return_rate"))


def add_context_flags(df: DataFrame) -> DataFrame:
    bargain = (F.col("coupon_usage_rate") > 0.4) & (F.col("return_rate") < 0.2)
    office = (F.col("shared_address_count") > 0) & (F.col("return_rate") < 0.1)
    return df.withColumns(
        {"looks_bargain": bargain.cast("bigint"), "looks_office": office.cast("bigint")}
    )
