"""Per-account time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.constants import CREATION_WINDOW_US, CUTOFF, DAY_US
from verdigris.functions.exprs import micros, safe_div, ts
from verdigris.functions.running import running_sums

WINDOWS = {"24h": 1, "7d": 7, "30d": 30}


def _within(column: str, days: int, cutoff: str) -> Column:
    """column in (cutoff - days, cutoff]."""
    at = micros(ts(cutoff))
    t = micros(column)
    return (t > at - F.lit(days * DAY_US)) & (t <= at)


def order_time_aggregates(cutoff: str = CUTOFF) -> list[Column]:
    """All order-clock aggregates in one pass; windows are conditions, not extra joins."""
    recent = _within("order_timestamp", 30, cutoff)
    returned = (
        F.coalesce(F.col("return_flag"), F.lit(False)) & (F.col("return_timestamp") <= ts(cutoff))
    )
    t = micros("order_timestamp")
    hour = F.hour("order_timestamp")
    return [
        *[
            F.count_if(_within("order_timestamp", d, cutoff)).alias(f"orders_last_{n}")
            for n, d in WINDOWS.items()
        ],
        F.count_if(recent & returned).alias("_recent_returns"),
        (F.max(t) - F.min(t)).alias("_span_us"),
        F.count("order_timestamp").alias("_clock_orders"),
        F.avg(((hour >= 18) & (hour <= 22)).cast("double")).alias("evening_order_ratio"),
    ]


def refund_windows(refunds: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    return refunds.groupBy("account_id").agg(
        *[
            F.count_if(_within("refund_timestamp", d, cutoff)).alias(f"refunds_last_{n}")
            for n, d in WINDOWS.items()
        ]
    )


def age_days(cutoff: str = CUTOFF) -> Column:
    age = (micros(ts(cutoff)) - micros("account_created_at")) / F.lit(float(DAY_US))
    return F.greatest(age, F.lit(0.0))


def lifetime_days() -> Column:
    return F.coalesce(F.col("_span_us") / F.lit(float(DAY_US)), F.lit(0.0))


def order_gap_days() -> Column:
    """Mean gap between successive orders = (last - first) / (n - 1); no per-account sort."""
    gaps = F.col("_clock_orders") - 1
    return F.when(gaps > 0, F.col("_span_us") / F.lit(float(DAY_US)) / gaps).otherwise(F.lit(0.0))


def burst(last_day: str, last_month: str) -> Column:
    per_day = F.greatest(F.col(last_month) / F.lit(30.0), F.lit(1.0))
    return F.col(last_day).cast("double") / per_day


def creation_bursts(
    accounts: DataFrame, cutoff: str = CUTOFF, window_us: int = CREATION_WINDOW_US
) -> DataFrame:
    """Other accounts created within the window of each account created by the cutoff.

    Counted from running totals over distinct creation times (arrivals up to t + w minus
    arrivals before t - w), so neither pairs nor a window over a busy hour are needed.
    """
    times = (
        accounts.select(micros("account_created_at").alias("t"))
        .filter(F.col("t") <= micros(ts(cutoff)))
        .groupBy("t")
        .agg(F.count("*").alias("n"))
    )
    marks = times.select(
        "t",
        F.explode(
            F.array(
                F.struct((F.col("t") - window_us).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("add")),
                F.struct(F.col("t").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("add")),
                F.struct((F.col("t") + window_us).alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("add")),
            )
        ).alias("m"),
    ).select("t", "m.*")
    seen = running_sums(
        marks, [F.col("at").asc(), F.col("kind").asc(), F.col("t").asc()], {"upto": F.col("add")}
    )
    per_time = seen.groupBy("t").agg(
        (
            F.max(F.when(F.col("kind") == 2, F.col("upto")))
            - F.max(F.when(F.col("kind") == 0, F.col("upto")))
            - 1
        ).alias("account_creation_burst_score")
    )
    keyed = accounts.select("account_id", micros("account_created_at").alias("t"))
    return keyed.join(per_time, "t", "left").select(
        "account_id",
        F.coalesce("account_creation_burst_score", F.lit(0).cast("bigint")).alias(
            "account_creation_burst_score"
        ),
    )


def add_temporal(
    features: DataFrame, accounts: DataFrame, refunds: DataFrame, cutoff: str = CUTOFF
) -> DataFrame:
    """Temporal columns on a frame built with ``order_time_aggregates`` in its order pass."""
    joined = features.join(refund_windows(refunds, cutoff), "account_id", "left").join(
        creation_bursts(accounts, cutoff), "account_id", "left"
    )
    counts = [f"{k}_last_{n}" for k in ("orders", "refunds") for n in WINDOWS]
    zero = F.lit(0).cast("bigint")
    joined = joined.withColumns(
        {c: F.coalesce(F.col(c), zero) for c in [*counts, "_recent_returns", "_clock_orders"]}
    )
    return joined.withColumns(
        {
            "account_age_days": age_days(cutoff),
            "return_rate_last_30d": safe_div(F.col("_recent_returns"), F.col("orders_last_30d")),
            "account_lifetime_days": lifetime_days(),
            "avg_order_gap_days": order_gap_days(),
            "recent_activity_ratio": F.col("orders_last_7d")
            / F.greatest(F.col("total_orders"), F.lit(1)),
            "evening_order_ratio": F.coalesce("evening_order_ratio", F.lit(0.0)),
            "transaction_burst_score": burst("orders_last_24h", "orders_last_30d"),
            "refund_burst_score": burst("refunds_last_24h", "refunds_last_30d"),
        }
    ).drop("_recent_returns", "_span_us", "_clock_orders")
