"""Per-account order behavior: one aggregation over the orders, left-joined to the accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.constants import CUTOFF, RARE_COUPON_ROWS
from verdigris.functions.exprs import nonblank, safe_div, ts
from verdigris.operators.cleansing import status_as_of

ENTITY_COUNTS = {
    "distinct_devices": "device_id",
    "distinct_addresses": "address_id",
    "distinct_phones": "phone_hash",
    "distinct_payment_instruments": "instrument_id",
}
ZERO_COUNTS = [
    "total_orders", *ENTITY_COUNTS, "total_delivered_orders", "total_failed_orders",
    "total_pending_orders", "distinct_coupon_count", "rare_coupon_count", "total_returns",
    "total_refunds", "total_disputes",
]
ZERO_AMOUNTS = [
    "total_amount", "avg_order_value", "coupon_usage_rate", "discount_dependency_score",
    "max_discount_ratio", "avg_return_lag_hours", "total_refund_amount",
]


def order_aggregates(cutoff: str = CUTOFF) -> list[Column]:
    """Every behavior aggregate over an account's pre-cutoff orders."""
    status = status_as_of(cutoff)
    ratio = safe_div(F.col("discount_amount"), F.col("amount"))
    returned = (
        F.coalesce(F.col("return_flag"), F.lit(False))
        & F.col("return_timestamp").isNotNull()
        & (F.col("return_timestamp") <= ts(cutoff))
    )
    return [
        F.count("order_id").alias("total_orders"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_order_value"),
        *[F.countDistinct(c).alias(n) for n, c in ENTITY_COUNTS.items()],
        *[
            F.count_if(status == s).alias(f"total_{s}_orders")
            for s in ("delivered", "failed", "pending")
        ],
        F.avg(nonblank("coupon_code").cast("double")).alias("coupon_usage_rate"),
        F.avg(ratio).alias("discount_dependency_score"),
        F.countDistinct("coupon_code").alias("distinct_coupon_count"),
        F.max(ratio).alias("max_discount_ratio"),
        F.count_if(returned).alias("total_returns"),
        F.avg(F.when(returned, F.col("return_lag_hours"))).alias("avg_return_lag_hours"),
    ]


def rare_coupon_counts(orders: DataFrame, below: int = RARE_COUPON_ROWS) -> DataFrame:
    """Orders per account whose coupon code is on fewer than ``below`` rows of the whole table.

    Rows are first folded per (code, account); a code kept here has under ``below`` rows, so
    its fold is tiny, while a common code never reaches the join's output.
    """
    uses = (
        orders.filter(F.col("coupon_code").isNotNull())
        .groupBy("coupon_code", "account_id")
        .agg(F.count("*").alias("uses"))
    )
    rare = uses.groupBy("coupon_code").agg(F.sum("uses").alias("rows")).filter(F.col("rows") < below)
    return (
        uses.join(rare.select("coupon_code"), "coupon_code", "left_semi")
        .groupBy("account_id")
        .agg(F.sum("uses").alias("rare_coupon_count"))
    )


def refund_totals(refunds: DataFrame) -> DataFrame:
    return refunds.groupBy("account_id").agg(
        F.count("refund_id").alias("total_refunds"),
        F.sum("refund_amount").alias("total_refund_amount"),
    )


def dispute_totals(disputes: DataFrame) -> DataFrame:
    return disputes.groupBy("account_id").agg(F.count("dispute_id").alias("total_disputes"))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Zero for accounts without activity; a column nobody produced is created as zero."""
    fixes = {}
    for names, zero in ((ZERO_COUNTS, F.lit(0).cast("bigint")), (ZERO_AMOUNTS, F.lit(0.0))):
        for n in names:
            fixes[n] = F.coalesce(F.col(n), zero) if n in df.columns else zero
    return df.withColumns(fixes)


def add_rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "return_rate": safe_div(F.col("total_returns"), F.col("total_delivered_orders")),
            "refund_rate": safe_div(F.col("total_refunds"), F.col("total_orders")),
            "dispute_rate": safe_div(F.col("total_disputes"), F.col("total_orders")),
        }
    )


def behavior_features(
    accounts: DataFrame,
    orders: DataFrame,
    refunds: DataFrame,
    disputes: DataFrame,
    cutoff: str = CUTOFF,
    more_aggregates: list[Column] | None = None,
) -> DataFrame:
    """One row per account. Inputs other than ``accounts`` are already cut off.

    ``more_aggregates`` lets other feature blocks ride on the same pass over the orders.
    """
    per_order = orders.groupBy("account_id").agg(*order_aggregates(cutoff), *(more_aggregates or []))
    joined = (
        accounts.select("account_id", "account_created_at")
        .join(per_order, "account_id", "left")
        .join(rare_coupon_counts(orders), "account_id", "left")
        .join(refund_totals(refunds), "account_id", "left")
        .join(dispute_totals(disputes), "account_id", "left")
    )
    return add_rates(fill_defaults(joined))
