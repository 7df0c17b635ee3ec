"""Node metrics of the account graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.constants import EDGE_WEIGHTS
from verdigris.functions.skew import CELL_ROWS, grid_sides
from verdigris.operators.components import account_components
from verdigris.operators.edges import both_directions
from verdigris.session import discard, materialize


def degree_metrics(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge count, weight sum, centrality and edge counts by type, in one aggregation."""
    per_node = both_directions(edges).groupBy("src").agg(
        F.count("*").alias("shared_edge_count"),
        F.sum("weight").alias("shared_edge_weight_sum"),
        *[F.count_if(F.col("edge_type") == t).alias(f"edge_{t}") for t in EDGE_WEIGHTS],
    )
    n = accounts.count()
    joined = accounts.select("account_id").join(
        per_node.withColumnRenamed("src", "account_id"), "account_id", "left"
    )
    zero = F.lit(0).cast("bigint")
    whole = ["shared_edge_count", *[f"edge_{t}" for t in EDGE_WEIGHTS]]
    return joined.select(
        "account_id",
        *[F.coalesce(F.col(c), zero).alias(c) for c in whole],
        F.coalesce("shared_edge_weight_sum", F.lit(0.0)).alias("shared_edge_weight_sum"),
        (F.coalesce("shared_edge_count", zero) / F.lit(float(max(n - 1, 1)))).alias("degree_centrality"),
    )


def _dealt(links: DataFrame) -> DataFrame:
    """Links laid out and sorted by source once, as the rounds' joins want them, so that a round moves and sorts ranks only.

    They are kept beside the stored table; a lost executor reads its share of that again.
    """
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = links.repartition(n, "src").sortWithinPartitions("src").persist()
    dealt.count()  # a layout is used once it is there
    return dealt


def _inflow(links: DataFrame, ranks: DataFrame) -> DataFrame:
    met = links.join(ranks, links["src"] == ranks["v"])
    return met.groupBy("dst").agg(F.sum(F.col("r") * F.col("share")).alias("inflow"))


def pagerank(
    accounts: DataFrame,
    edges: DataFrame,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1e-6,
    keep_every: int = 4,
) -> DataFrame:
    """Weighted PageRank with uniform dangling mass.

    In an undirected graph the dangling vertices are the isolated ones and all hold one
    common rank, which follows a scalar recurrence. Only connected vertices are iterated,
    and no global sum over the vertices is needed for the dangling share. Raises if not
    converged; ``tol`` 0 asks for exactly ``max_iter`` rounds.
    """
    n = accounts.count()
    sym = both_directions(edges).select("src", "dst", "weight")
    out_weight = sym.groupBy("src").agg(F.sum("weight").alias("out_weight"))
    links = _dealt(materialize(
        sym.join(out_weight, "src").select("src", "dst", (F.col("weight") / F.col("out_weight")).alias("share")),
        "pr-links",
    ))
    nodes = materialize(out_weight.select(F.col("src").alias("v")), "pr-nodes")
    isolated = n - nodes.count()
    lone = 1.0 / n
    ranks, kept = nodes.withColumn("r", F.lit(1.0 / n)), None
    for turn in range(1, max_iter + 1):
        lone_next = (1.0 - alpha) / n + alpha * isolated * lone / n
        inflow = _inflow(links, ranks)
        fresh = inflow.select(
            F.col("dst").alias("v"), (F.lit(lone_next) + F.lit(alpha) * F.col("inflow")).alias("r")
        )
        if turn % keep_every == 0 or turn == max_iter:
            if tol > 0:
                both = fresh.join(ranks.withColumnRenamed("r", "old"), "v")
                both = materialize(both, "pr")
                moved = both.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0
                discard(kept)
                ranks, kept = both.select("v", "r"), both
                if moved + isolated * abs(lone_next - lone) < n * tol:
                    lone = lone_next
                    break
            else:
                fresh = materialize(fresh, "pr")
                discard(kept)
                ranks, kept = fresh, fresh
        else:
            ranks = fresh
        lone = lone_next
    else:
        if tol > 0:
            raise RuntimeError(f"PageRank did not converge in {max_iter} rounds")
    links.unpersist()
    return (
        accounts.select("account_id")
        .join(ranks.withColumnRenamed("v", "account_id"), "account_id", "left")
        .select("account_id", F.coalesce("r", F.lit(lone)).alias("pagerank"))
    )


def eigenvector_centrality(
    accounts: DataFrame,
    edges: DataFrame,
    max_iter: int = 1000,
    tol: float = 1e-6,
    fixed: bool = False,
    keep_every: int = 5,
) -> DataFrame:
    """Weighted eigenvector centrality: power iteration on A + I from a uniform start.

    Scaling commutes with the iteration, so lengths are normalized and compared once per
    ``keep_every`` rounds, and only those rounds are stored, the values before beside the new. Isolated vertices keep their start
    value up to scale, a scalar. Raises if not converged, unless ``fixed`` asks for exactly
    ``max_iter`` rounds.
    """
    n = accounts.count()
    sym = both_directions(edges).select("src", "dst", "weight")
    nodes = materialize(sym.select(F.col("src").alias("v")).distinct(), "ev-nodes")
    loops = nodes.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("weight"))
    links = _dealt(materialize(sym.unionByName(loops), "ev-links"))
    isolated = n - nodes.count()

    def grow(x: DataFrame, *more: Column) -> DataFrame:
        met = links.join(x, links["src"] == x["v"])
        return met.groupBy("dst").agg(F.sum(F.col("x") * F.col("weight")).alias("x"), *more).withColumnRenamed("dst", "v")

    before = F.max(F.when(F.col("src") == F.col("dst"), F.col("x"))).alias("old")  # every vertex meets itself by its loop
    both = None
    x, lone, done, turn = nodes.withColumn("x", F.lit(1.0 / n)), 1.0 / n, False, 0
    while turn < max_iter and not done:
        rounds = min(keep_every, max_iter - turn)
        for _ in range(rounds - 1):
            x = grow(x)
        last, both = both, materialize(grow(x, before).filter("v IS NOT NULL"), "ev")
        discard(last)
        size = both.agg(F.sum(F.col("old") * F.col("old")).alias("o"), F.sum(F.col("x") * F.col("x")).alias("x")).first()
        rest = isolated * lone * lone
        old_len, new_len = (((size[k] or 0.0) + rest) ** 0.5 or 1.0 for k in ("o", "x"))
        if not fixed:
            gap = F.abs(F.col("x") / F.lit(new_len) - F.col("old") / F.lit(old_len))
            moved = (both.agg(F.sum(gap)).first()[0] or 0.0) + isolated * abs(lone / new_len - lone / old_len)
            done = moved < n * tol
        x = both.select("v", (F.col("x") / F.lit(new_len)).alias("x"))
        lone, turn = lone / new_len, turn + rounds
    if not done and not fixed:
        raise RuntimeError(f"eigenvector centrality did not converge in {max_iter} rounds")
    links.unpersist()
    return (
        accounts.select("account_id")
        .join(x.withColumnRenamed("v", "account_id"), "account_id", "left")
        .select("account_id", F.coalesce("x", F.lit(lone)).alias("eigenvector_centrality"))
    )


def triangles(edges: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Each triangle once: corners a, b, c and weights w_ab, w_ac, w_bc.

    Edges point from the lower (degree, id) end to the higher, which bounds every
    out-degree by the square root of twice the edge count. The wedges of a vertex with more
    out-edges than ``cell_rows`` are dealt by the colors of their two other corners: a cell
    holds the edges to one color beside those to another, so no task holds all of them.
    """
    degree = both_directions(edges).groupBy("src").agg(F.count("*").alias("deg"))
    d1 = degree.select(F.col("src").alias("account_id_1"), F.col("deg").alias("deg1"))
    d2 = degree.select(F.col("src").alias("account_id_2"), F.col("deg").alias("deg2"))
    sized = edges.join(d1, "account_id_1").join(d2, "account_id_2")
    first = F.struct("deg1", "account_id_1") < F.struct("deg2", "account_id_2")
    directed = materialize(
        sized.select(
            F.when(first, F.col("account_id_1")).otherwise(F.col("account_id_2")).alias("s"),
            F.when(first, F.col("account_id_2")).otherwise(F.col("account_id_1")).alias("t"),
            F.when(first, F.col("deg2")).otherwise(F.col("deg1")).alias("t_deg"),
            "weight",
        ),
        "tri-edges",
    )
    ab = directed.select(F.col("s").alias("a"), F.col("t").alias("b"), F.col("t_deg").alias("b_deg"), F.col("weight").alias("w_ab"))
    ac = directed.select(F.col("s").alias("a"), F.col("t").alias("c"), F.col("t_deg").alias("c_deg"), F.col("weight").alias("w_ac"))
    bc = directed.select(F.col("s").alias("b"), F.col("t").alias("c"), F.col("weight").alias("w_bc"))
    left, right, on = grid_sides(ab, ac, ["a"], "b", "c", cell_rows)
    wedges = left.join(right, on).filter(F.struct("b_deg", "b") < F.struct("c_deg", "c"))
    return wedges.join(bc, ["b", "c"]).select("a", "b", "c", "w_ab", "w_ac", "w_bc")


def triangle_metrics(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """triangle_count and weighted clustering_coefficient from one triangle pass."""
    top = edges.agg(F.max("weight")).first()[0] or 1.0
    strength = F.pow(
        (F.col("w_ab") / F.lit(top)) * (F.col("w_ac") / F.lit(top)) * (F.col("w_bc") / F.lit(top)),
        F.lit(1.0 / 3.0),
    )
    corners = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("v"), strength.alias("s"))
    per_node = corners.groupBy("v").agg(F.count("*").alias("tri"), F.sum("s").alias("s"))
    degree = both_directions(edges).groupBy("src").agg(F.count("*").alias("deg"))
    joined = (
        accounts.select("account_id")
        .join(per_node.withColumnRenamed("v", "account_id"), "account_id", "left")
        .join(degree.withColumnRenamed("src", "account_id"), "account_id", "left")
    )
    return joined.select(
        "account_id",
        F.coalesce("tri", F.lit(0).cast("bigint")).alias("triangle_count"),
        F.when(F.col("deg") > 1, 2.0 * F.coalesce("s", F.lit(0.0)) / (F.col("deg") * (F.col("deg") - 1)))
        .otherwise(F.lit(0.0))
        .alias("clustering_coefficient"),
    )


def integrity_report(accounts: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row of structural totals and warnings."""
    nodes = degree_metrics(accounts, edges).agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("shared_edge_count") == 0).alias("isolated_nodes"),
        F.max("shared_edge_count").alias("max_degree"),
    )
    links = edges.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("account_id_1") == F.col("account_id_2")).alias("self_loops"),
    )
    groups = components.groupBy("component").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("connected_components"), F.max("n").alias("largest_component")
    )
    key = F.lit(1).alias("one")
    row = (
        nodes.select("*", key)
        .join(links.select("*", key), "one")
        .join(groups.select("*", key), "one")
        .drop("one")
    )
    return row.withColumns(
        {
            "fully_connected_warning": F.col("largest_component") == F.col("nodes"),
            "mostly_isolated_warning": F.col("isolated_nodes") > F.col("nodes") * 0.9,
        }
    )


def node_metrics(accounts: DataFrame, edges: DataFrame, iterative: bool = True) -> DataFrame:
    """All node metrics, one row per account."""
    out = degree_metrics(accounts, edges)
    out = out.join(triangle_metrics(accounts, edges), "account_id")
    sizes = account_components(accounts, edges).select(
        "account_id", F.col("component_size").alias("connected_component_size")
    )
    out = out.join(sizes, "account_id")
    if iterative:
        out = out.join(pagerank(accounts, edges), "account_id")
        out = out.join(eigenvector_centrality(accounts, edges), "account_id")
    return out
