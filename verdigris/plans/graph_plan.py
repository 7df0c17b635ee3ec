"""The graph feature matrix: account features with graph, community and neighbor columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from verdigris.operators.cleansing import drop_leakage, fill_finite
from verdigris.operators.community_features import add_context_flags, checked_join, community_features, neighbor_return_rates
from verdigris.operators.graph_metrics import node_metrics
from verdigris.session import materialize


def graph_matrix(features: DataFrame, edges: DataFrame, communities: DataFrame, iterative: bool = True) -> DataFrame:
    """``features`` and ``edges`` are stored tables; each is read several times.

    What moves the edges is stored once: the joins' checks read both sides before the joins do.
    """
    accounts = features.select("account_id")
    out = checked_join(features, materialize(node_metrics(accounts, edges, iterative), "node-metrics"), ["account_id"])
    out = checked_join(out, materialize(community_features(features, communities), "community-features"), ["account_id"])
    out = checked_join(out, materialize(neighbor_return_rates(features, edges), "neighbor-rates"), ["account_id"])
    return fill_finite(drop_leakage(add_context_flags(out)), skip=("account_id", "community_id"))
