"""Ring candidates: seed components, their statistics, labels and ranked views.

Membership is kept long (candidate_id, account_id), so a candidate that swallows a large
share of the accounts is still spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import ACTIONS, EDGE_LABELS, EDGE_WEIGHTS, FORBIDDEN_COLUMNS, MIN_CANDIDATE, SCORE_TIERS, SEED_SCORE, STRONG_EDGE
from verdigris.functions.exprs import lookup, safe_div, tier_of_score
from verdigris.functions.running import quantiles, ranked
from verdigris.operators.components import component_labels

MEMBER_AGGREGATES = {
    "total_orders": "sum", "total_amount": "sum", "avg_order_value": "mean", "total_returns": "sum",
    "return_rate": "mean", "return_rate_last_30d": "mean", "total_refunds": "sum",
    "total_refund_amount": "sum", "refund_rate": "mean", "total_disputes": "sum", "dispute_rate": "mean",
    "transaction_burst_score": "mean", "refund_burst_score": "mean", "account_creation_burst_score": "mean",
    "discount_dependency_score": "mean", "shared_entity_types_count": "mean", "shared_edge_weight_sum": "mean",
    "community_return_rate": "mean", "community_refund_rate": "mean", "community_avg_order_value": "mean",
}
EDGE_COUNT_NAMES = {
    "shares_device": "shared_device_edges", "shares_address": "shared_address_edges",
    "shares_phone": "shared_phone_edges", "shares_payment_instrument": "shared_payment_edges",
    "shares_ip_prefix": "shared_ip_edges", "shares_coupon": "shared_coupon_edges",
}


def candidate_edges(scores: DataFrame, edges: DataFrame, score: str, seed_score: float = SEED_SCORE, strong: float = STRONG_EDGE) -> DataFrame:
    """Strong edges with a seed account at both ends."""
    seeds = scores.filter(F.col(score) >= seed_score).select("account_id")
    kept = edges.filter(F.col("weight") >= strong)
    kept = kept.join(seeds.withColumnRenamed("account_id", "account_id_1"), "account_id_1", "left_semi")
    return kept.join(seeds.withColumnRenamed("account_id", "account_id_2"), "account_id_2", "left_semi").select(
        "account_id_1", "account_id_2", "edge_type", "weight"
    )


def candidate_members(strong_edges: DataFrame, min_size: int = MIN_CANDIDATE) -> DataFrame:
    """(candidate_id, account_id); ids follow the order of each component's smallest member."""
    labels = component_labels(strong_edges)
    groups = labels.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    named = ranked(groups, [F.col("component").asc()], name="p").select(
        "component", F.format_string("RING-C%04d", F.col("p")).alias("candidate_id")
    )
    return labels.join(named, "component").select("candidate_id", F.col("id").alias("account_id"))


def member_pages(members: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Sorted member arrays for export, cut into pages of bounded length."""
    placed = ranked(members, [F.col("account_id").asc()], ["candidate_id"], "p")
    page = F.floor((F.col("p") - 1) / F.lit(page_size)).cast("int")
    return placed.groupBy("candidate_id", page.alias("page")).agg(
        F.array_sort(F.collect_list("account_id")).alias("member_ids")
    )


def score_stats(members: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """Count, mean, median, max, min, population std and p90 of member scores."""
    s = members.join(scores.select("account_id", F.col(score).alias("s")), "account_id", "left")
    s = s.select("candidate_id", F.coalesce("s", F.lit(0.0)).alias("s"))
    base = s.groupBy("candidate_id").agg(
        F.count("*").alias("member_count"), F.avg("s").alias("mean_account_risk"),
        F.max("s").alias("max_account_risk"), F.min("s").alias("min_account_risk"),
        F.stddev_pop("s").alias("std_account_risk"),
    )
    q = quantiles(s, ["candidate_id"], "s", {"median_account_risk": 0.5, "p90_account_risk": 0.9})
    return base.join(q, "candidate_id")


def internal_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are members of one candidate."""
    m1 = members.select("candidate_id", F.col("account_id").alias("account_id_1"))
    m2 = members.select(F.col("candidate_id").alias("other"), F.col("account_id").alias("account_id_2"))
    return edges.join(m1, "account_id_1").join(m2, "account_id_2").filter(
        F.col("candidate_id") == F.col("other")
    ).drop("other")


def edge_stats(members: DataFrame, edges: DataFrame, strong: float = STRONG_EDGE) -> DataFrame:
    """Strong internal edges: count, density, weights, counts by type."""
    inside = internal_edges(members, edges.filter(F.col("weight") >= strong))
    per = inside.groupBy("candidate_id").agg(
        F.count("*").alias("internal_edge_count"), F.avg("weight").alias("mean_edge_weight"),
        F.max("weight").alias("max_edge_weight"),
        *[F.count_if(F.col("edge_type") == t).alias(n) for t, n in EDGE_COUNT_NAMES.items()],
    )
    sizes = members.groupBy("candidate_id").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    return sizes.join(per, "candidate_id", "left").select(
        "candidate_id",
        F.coalesce("internal_edge_count", zero).alias("internal_edge_count"),
        safe_div(F.coalesce("internal_edge_count", zero), F.col("n") * (F.col("n") - 1) / 2).alias("internal_edge_density"),
        F.coalesce("mean_edge_weight", F.lit(0.0)).alias("mean_edge_weight"),
        F.coalesce("max_edge_weight", F.lit(0.0)).alias("max_edge_weight"),
        *[F.coalesce(n, zero).alias(n) for n in EDGE_COUNT_NAMES.values()],
    )


def community_mix(members: DataFrame, communities: DataFrame) -> DataFrame:
    """(candidate_id, community_id, n_members) plus the number of source communities."""
    per = members.join(communities, "account_id").groupBy("candidate_id", "community_id").agg(F.count("*").alias("n_members"))
    n = per.groupBy("candidate_id").agg(F.count("*").alias("candidate_community_count"))
    return per.join(n, "candidate_id")


def member_aggregates(members: DataFrame, matrix: DataFrame) -> DataFrame:
    """The 20 sums and means over member features."""
    cols = {c: how for c, how in MEMBER_AGGREGATES.items() if c in matrix.columns}
    j = members.join(matrix.select("account_id", *cols), "account_id", "left")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return j.groupBy("candidate_id").agg(
        *[(F.sum if how == "sum" else F.avg)(value(c)).alias(f"ring_{c}_{how}") for c, how in cols.items()]
    )


def candidate_table(members: DataFrame, scores: DataFrame, score: str, edges: DataFrame, communities: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row of model inputs per candidate."""
    mix = community_mix(members, communities).groupBy("candidate_id").agg(F.count("*").alias("candidate_community_count"))
    return (
        score_stats(members, scores, score)
        .join(edge_stats(members, edges), "candidate_id")
        .join(mix, "candidate_id", "left")
        .join(member_aggregates(members, matrix), "candidate_id")
        .fillna(0, ["candidate_community_count"])
    )


def positive_rings(members: DataFrame, truth: DataFrame, at_least: int = 2) -> DataFrame:
    """(candidate_id, abuse_ring_id, n_members) for rings with enough members inside."""
    inside = members.join(truth.filter("true_ring_member").select("account_id", "abuse_ring_id"), "account_id")
    return inside.groupBy("candidate_id", "abuse_ring_id").agg(F.count("*").alias("n_members")).filter(
        F.col("n_members") >= at_least
    )


def candidate_labels(members: DataFrame, positives: DataFrame) -> DataFrame:
    """(candidate_id, is_abuse_ring, n_positive_rings)."""
    per = positives.groupBy("candidate_id").agg(F.count("*").alias("n"))
    return members.select("candidate_id").distinct().join(per, "candidate_id", "left").select(
        "candidate_id",
        (F.coalesce("n", F.lit(0)) > 0).cast("bigint").alias("is_abuse_ring"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n_positive_rings"),
    )


def ring_coverage(truth: DataFrame, positives: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: rings represented by candidates, test rings, detected test rings, ring recall.

    ``scored`` has candidate_id, split and ring_pred.
    """
    total = truth.filter("true_ring_member").agg(F.countDistinct("abuse_ring_id").alias("true_rings"), F.lit(1).alias("one"))
    seen = positives.join(scored, "candidate_id").agg(
        F.countDistinct("abuse_ring_id").alias("represented_rings"),
        F.countDistinct(F.when(F.col("split") == "test", F.col("abuse_ring_id"))).alias("test_rings"),
        F.countDistinct(F.when((F.col("split") == "test") & (F.col("ring_pred") == 1), F.col("abuse_ring_id"))).alias("detected_test_rings"),
        F.lit(1).alias("one"),
    )
    return total.join(seen, "one").drop("one").withColumn(
        "ring_recall", safe_div(F.col("detected_test_rings"), F.col("test_rings"))
    )


def leaked_inputs(table: DataFrame, forbidden: list[str] | None = None) -> DataFrame:
    """Each forbidden column: whether the model table holds it, and in how many rows."""
    names = forbidden or FORBIDDEN_COLUMNS
    items = F.array(*[
        F.struct(
            F.lit(n).alias("column_name"), F.lit(n in table.columns).alias("present"),
            (F.count(n) if n in table.columns else F.lit(0)).cast("bigint").alias("filled_rows"),
        )
        for n in names
    ])
    return table.agg(items.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def strongest_internal(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Heaviest internal edge per candidate (all weights); pair order breaks ties."""
    best = F.struct("edge_type", "weight", "account_id_1", "account_id_2")
    order = F.struct(-F.col("weight"), F.col("account_id_1"), F.col("account_id_2"))
    return internal_edges(members, edges).groupBy("candidate_id").agg(F.min_by(best, order).alias("e")).select(
        "candidate_id",
        F.col("e.edge_type").alias("strongest_edge_type"),
        F.col("e.weight").alias("strongest_edge_weight"),
        F.col("e.account_id_1").alias("strongest_source"),
        F.col("e.account_id_2").alias("strongest_target"),
        lookup(F.col("e.edge_type"), EDGE_LABELS, F.col("e.edge_type")).alias("strongest_label"),
    )


def list_rings(table: DataFrame, strongest: DataFrame, limit: int | None = None, detected_only: bool = False) -> DataFrame:
    """Rings by score with tier, action, exposure and strongest edge: all, or the first ``limit``.

    ``table`` carries ring_proba, ring_pred and the candidate columns.
    """
    rows = table.filter(F.col("ring_pred") == 1) if detected_only else table
    top = rows if limit is None else rows.orderBy(F.col("ring_proba").desc(), F.col("candidate_id").asc()).limit(limit)
    tier = tier_of_score(F.col("ring_proba"), SCORE_TIERS)
    return (
        top.withColumn("risk_tier", tier)
        .join(strongest, "candidate_id", "left")
        .select(
            "candidate_id", F.col("ring_proba").alias("ring_score"), (F.col("ring_pred") == 1).alias("detected"),
            "risk_tier", lookup(F.col("risk_tier"), {t: a[1] for t, a in ACTIONS.items()}).alias("recommended_action"),
            "member_count", F.col("ring_total_refund_amount_sum").alias("exposure"), "mean_account_risk",
            "max_account_risk", "internal_edge_count", "strongest_edge_type", "strongest_edge_weight",
        )
    )


def ranked_members(members: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """Members with their place in the ring by score."""
    s = members.join(scores.select("account_id", F.col(score).alias("account_risk")), "account_id", "left")
    s = s.withColumn("account_risk", F.coalesce("account_risk", F.lit(0.0)))
    return ranked(s, [F.col("account_risk").desc(), F.col("account_id").asc()], ["candidate_id"], "rank_in_ring")


def ring_edge_counts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal edges by type, all weights."""
    return internal_edges(members, edges).groupBy("candidate_id").agg(
        *[F.count_if(F.col("edge_type") == t).alias(f"n_{t}") for t in EDGE_WEIGHTS]
    )
