"""The fixed rule baseline and the run gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ["rule_1", "rule_2", "rule_3", "rule_4", "rule_5"]


def apply_rules(matrix: DataFrame) -> DataFrame:
    """Five rule flags and their OR as ``baseline_flag``."""
    c = F.col
    rules = {
        "rule_1": (c("return_rate") > 0.5) & (c("total_orders") >= 2),
        "rule_2": (c("shared_device_count") >= 1) & (c("return_rate") > 0.3),
        "rule_3": (c("account_creation_burst_score") >= 5) & (c("coupon_usage_rate") > 0.5),
        "rule_4": (c("community_size") >= 4) & (c("community_return_rate") > 0.4),
        "rule_5": c("dispute_rate") > 0.3,
    }
    out = matrix.withColumns({n: e.cast("bigint") for n, e in rules.items()})
    return out.withColumn("baseline_flag", F.greatest(*RULES))


def rule_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        *[F.sum(r).alias(f"{r}_count") for r in RULES],
        F.sum("baseline_flag").alias("total_flagged"),
    )


def run_gate(rows_in: int, matrix: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: passed, and the reasons to stop. ``metrics`` is a one-row confusion table."""
    nulls = matrix.agg(
        F.count("*").alias("matrix_rows"),
        sum((F.count_if(F.col(c).isNull()) for c in matrix.columns), F.lit(0).cast("bigint")).alias("null_cells"),
    )
    row = nulls.select("*", F.lit(1).alias("one")).join(metrics.select("*", F.lit(1).alias("one")), "one")
    c = F.col
    tests = [
        (c("matrix_rows") != rows_in, "row count changed"),
        (c("null_cells") > 0, "null values"),
        (~c("precision").between(1e-12, 1 - 1e-12), "trivial precision"),
        (~c("recall").between(1e-12, 1 - 1e-12), "trivial recall"),
        (c("tp") == 0, "no true member caught"),
        (c("tp") + c("fp") == 0, "no account flagged"),
    ]
    reasons = F.filter(F.array(*[F.when(t, F.lit(m)) for t, m in tests]), lambda x: x.isNotNull())
    return row.select(
        (F.size(reasons) == 0).alias("passed"), reasons.alias("stop_reasons"), "matrix_rows", "null_cells"
    )
