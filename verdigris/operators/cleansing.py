"""Cutoff filters, as-of state, numeric cleansing and matrix checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.constants import CUTOFF, FORBIDDEN_COLUMNS
from verdigris.functions.exprs import finite_or_zero, number_or_zero, ts

# Table -> the column that decides whether a row existed at the cutoff.
CUTOFF_COLUMN = {
    "orders": "order_timestamp",
    "refunds": "refund_timestamp",
    "disputes": "dispute_created_at",
    "devices": "first_seen_at",
    "addresses": "first_seen_at",
    "phones": "first_seen_at",
    "payment_instruments": "first_seen_at",
}


def known_at(df: DataFrame, column: str, cutoff: str = CUTOFF) -> DataFrame:
    """Rows stamped at or before the cutoff; unstamped rows drop out."""
    return df.filter(F.col(column) <= ts(cutoff))


def filter_tables(tables: dict[str, DataFrame], cutoff: str = CUTOFF) -> dict[str, DataFrame]:
    """Cutoff every event and entity table; accounts stay whole."""
    return {
        name: known_at(df, CUTOFF_COLUMN[name], cutoff) if name in CUTOFF_COLUMN else df
        for name, df in tables.items()
    }


def status_as_of(cutoff: str = CUTOFF) -> F.Column:
    """Delivery status as it was at the cutoff."""
    return (
        F.when(F.col("delivery_status") == "failed", "failed")
        .when(F.col("delivery_timestamp") <= ts(cutoff), "delivered")
        .otherwise("pending")
    )


def drop_leakage(df: DataFrame, forbidden: list[str] | None = None) -> DataFrame:
    return df.drop(*(forbidden or FORBIDDEN_COLUMNS))


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("account_id",)) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def fill_finite(df: DataFrame, skip: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Infinities, NaN and nulls of numeric columns become 0; integer columns keep their type."""
    fixes = {}
    for f in df.schema:
        if f.name in skip or not isinstance(f.dataType, T.NumericType):
            continue
        if isinstance(f.dataType, T.FractionalType):
            fixes[f.name] = finite_or_zero(f.name)
        else:
            fixes[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
    return df.withColumns(fixes)


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: number_or_zero(c) for c in columns})


def matrix_violations(features: DataFrame) -> DataFrame:
    """One row: duplicate accounts, null cells, return rates without any delivery."""
    cells = [F.count_if(F.col(c).isNull()) for c in features.columns]
    total_nulls = cells[0]
    for c in cells[1:]:
        total_nulls = total_nulls + c
    rows = features.agg(
        F.count("*").alias("n_rows"),
        total_nulls.alias("null_cells"),
        F.count_if((F.col("return_rate") > 0) & (F.col("total_delivered_orders") == 0)).alias(
            "rate_without_delivery"
        ),
        F.countDistinct("account_id").alias("n_accounts"),
    )
    return rows.select(
        "n_rows",
        (F.col("n_rows") - F.col("n_accounts")).alias("duplicate_accounts"),
        "null_cells",
        "rate_without_delivery",
    )
