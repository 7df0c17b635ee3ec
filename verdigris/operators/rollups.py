"""Monitoring rollups over the queue, the overview graph and the detected rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import ACTIONS, EDGE_WEIGHTS
from verdigris.operators.components import component_labels
from verdigris.operators.edges import both_directions


def community_sizes(nodes: DataFrame) -> DataFrame:
    """Communities of more than one shown node."""
    return (
        nodes.filter(F.col("community_id").isNotNull())
        .groupBy("community_id").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    )


def rings_by_member(rings: DataFrame, members: DataFrame) -> DataFrame:
    """(account_id, candidate_id, ring columns) of detected rings; best score wins per account."""
    detected = rings.filter("detected").join(members, "candidate_id")
    row = F.struct("candidate_id", "ring_score", "risk_tier", "recommended_action", "detected")
    # negative order keeps the smaller candidate id on equal scores
    return detected.groupBy("account_id").agg(
        F.min_by(row, F.struct(-F.col("ring_score"), F.col("candidate_id"))).alias("r")
    ).select("account_id", "r.*")


def node_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group): community ids, or connected components when no node has one."""
    if nodes.filter(F.col("community_id").isNotNull()).isEmpty():
        labels = component_labels(links, "source", "target").withColumnRenamed("id", "node")
        joined = nodes.select("node").join(labels, "node", "left")
        return joined.select("node", F.concat(F.lit("component:"), F.coalesce("component", "node").cast("string")).alias("group"))
    return nodes.select(
        "node",
        F.coalesce(F.col("community_id").cast("string"), F.concat(F.lit("node:"), F.col("node").cast("string"))).alias("group"),
    )


def community_rollup(nodes: DataFrame, links: DataFrame, queue: DataFrame, ring_of: DataFrame) -> DataFrame:
    """One row per shown community: members, flagged, peak account, ring, internal links.

    ``links`` has source, target, edge_type, weight; communities of one unflagged node are left out.
    """
    groups = node_groups(nodes, links)
    q = queue.select(F.col("account_id").alias("node"), "proba")
    r = ring_of.withColumnRenamed("account_id", "node")
    j = groups.join(q, "node", "left").join(r, "node", "left")
    flagged = F.col("proba").isNotNull()
    ring = F.struct("candidate_id", "ring_score", "risk_tier", "recommended_action", "detected")
    has_ring = F.col("candidate_id").isNotNull()
    per = j.groupBy("group").agg(
        F.count("*").alias("members"),
        F.count_if(flagged).alias("flagged_members"),
        F.min_by(F.when(flagged, F.struct("node", "proba")), F.when(flagged, F.struct(-F.col("proba"), F.col("node")))).alias("peak"),
        F.min_by(F.when(has_ring, ring), F.when(has_ring, F.struct(-F.col("ring_score"), F.col("candidate_id")))).alias("ring"),
    )
    g1 = groups.select(F.col("node").alias("source"), "group")
    g2 = groups.select(F.col("node").alias("target"), F.col("group").alias("other"))
    inside = links.join(g1, "source").join(g2, "target").filter(F.col("group") == F.col("other"))
    edge = F.struct("edge_type", "weight", "source", "target")
    per_links = inside.groupBy("group").agg(
        F.count("*").alias("member_links"),
        *[F.count_if(F.col("edge_type") == t).alias(f"n_{t}") for t in EDGE_WEIGHTS],
        F.min_by(edge, F.struct(-F.col("weight"), F.col("source"), F.col("target"))).alias("e"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        per.join(per_links, "group", "left")
        .filter((F.col("members") > 1) | (F.col("flagged_members") > 0))
        .select(
            F.col("group").alias("community"), "members", "flagged_members",
            F.col("peak.node").alias("peak_account"), F.col("peak.proba").alias("peak_score"),
            F.coalesce("member_links", zero).alias("member_links"),
            *[F.coalesce(f"n_{t}", zero).alias(f"n_{t}") for t in EDGE_WEIGHTS],
            F.col("e.edge_type").alias("strongest_edge_type"), F.col("e.weight").alias("strongest_edge_weight"),
            F.col("ring.candidate_id").alias("ring_candidate"),
            F.coalesce("ring.ring_score", F.lit(0.0)).alias("ring_score"),
            F.coalesce("ring.detected", F.lit(False)).alias("ring_detected"),
            F.coalesce("ring.risk_tier", F.lit("LOW")).alias("ring_tier"),
            F.coalesce("ring.recommended_action", F.lit(ACTIONS["LOW"][1])).alias("ring_action"),
        )
    )


def sorted_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.col("ring_score").desc(), F.coalesce("peak_score", F.lit(0.0)).desc(), "community")


def filtered_degrees(links: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Node degree over links of one type (all types when None)."""
    kept = links if edge_type is None else links.filter(F.col("edge_type") == edge_type)
    sym = both_directions(kept.withColumnsRenamed({"source": "account_id_1", "target": "account_id_2"}))
    return sym.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def search_nodes(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes whose id contains the term, case ignored; a blank term keeps all."""
    t = term.strip().lower()
    return nodes if not t else nodes.filter(F.lower(F.col("node").cast("string")).contains(t))
