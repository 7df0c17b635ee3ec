"""The account feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import CUTOFF
from verdigris.operators.behavior import behavior_features
from verdigris.operators.cleansing import drop_leakage, fill_finite, known_at
from verdigris.operators.identity import add_identity
from verdigris.operators.temporal import add_temporal, order_time_aggregates


def feature_matrix(
    accounts: DataFrame,
    orders: DataFrame,
    refunds: DataFrame,
    disputes: DataFrame,
    devices: DataFrame,
    cutoff: str = CUTOFF,
) -> DataFrame:
    """One numeric, null-free row per account from everything known at the cutoff.

    Behavior and order-time features share one pass over the orders.
    """
    orders = known_at(orders, "order_timestamp", cutoff)
    refunds = known_at(refunds, "refund_timestamp", cutoff)
    disputes = known_at(disputes, "dispute_created_at", cutoff)
    devices = known_at(devices, "first_seen_at", cutoff)
    base = behavior_features(
        accounts, orders, refunds, disputes, cutoff, order_time_aggregates(cutoff)
    )
    timed = add_temporal(base, accounts, refunds, cutoff).drop("account_created_at")
    full = add_identity(timed, orders, devices)
    return fill_finite(drop_leakage(full))
