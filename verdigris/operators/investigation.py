"""Queue, tiers, actions, evidence, links, timelines, exposure and case reports.

Per-account lists of unbounded length (links, report lines) are kept as numbered rows; text
is assembled in pages of bounded length, so one hub account never fills one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.constants import ACTIONS, CUTOFF, EDGE_LABELS, EDGE_WEIGHTS, EVIDENCE_FIELDS, RANK_TIERS, TIERS
from verdigris.functions.exprs import lookup, safe_div, tier_of_rank, truthy, ts
from verdigris.functions.running import ranked, top_rows
from verdigris.operators.edges import both_directions

PAGE_LINKS = 1_000
PAGE_LINES = 5_000

# Merchant policies by category.
POLICIES = {
    "fashion": "Manual review required for refunds over ₹5000",
    "electronics": "Proof of delivery and return condition required",
}
DEFAULT_POLICY = "Standard refund policy: verify return reason before processing"
# Wording an action may never contain.
FORBIDDEN_PHRASES = ["block account", "ban account", "permanent ban", "automatically reject"]
# Tier limits of the two rank + community policies: (critical, high, medium).
COMMUNITY_POLICIES = {"v1": (2, 2, 5), "v4": (5, 20, 60)}
BEHAVIOR_FACTS = [
    "total_orders", "return_rate", "refund_rate", "dispute_rate", "shared_device_count",
    "shared_ip_prefix_count", "community_size",
]
# The observed facts of an account record.
RECORD_FACTS = [
    "total_orders", "total_amount", "total_refunds", "total_refund_amount", "return_rate", "refund_rate", "dispute_rate",
    "shared_device_count", "shared_ip_prefix_count", "community_size", "total_returns",
]
MODEL_VERSION = "Ensemble_LGBM_B_GNN"


# ------------------------------------------------------------------ ranking and actions
def rank_accounts(scores: DataFrame, score: str, threshold: float | None = None, top_k: int | None = None) -> DataFrame:
    """Every account with its rank (1 = highest) and a flag by threshold or by rank."""
    out = ranked(scores, [F.col(score).desc(), F.col("account_id").asc()])
    if threshold is not None:
        flag = F.col(score) >= threshold
    else:
        flag = F.col("rank") <= (top_k or 0)
    return out.withColumn("flagged", flag)


def flagged_queue(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best-scored accounts with rank, by a distributed top-k."""
    top = top_rows(
        scores.select("account_id", F.col(score).alias("proba")),
        [F.col("proba").desc(), F.col("account_id").asc()],
        k,
    )
    return with_actions(top)


def with_actions(ranked_rows: DataFrame) -> DataFrame:
    """Tier and bounded action from the rank."""
    out = ranked_rows.withColumn("risk_tier", tier_of_rank(F.col("rank"), RANK_TIERS))
    pick = lambda i: lookup(F.col("risk_tier"), {t: a[i] for t, a in ACTIONS.items()})
    return out.withColumns(
        {"action_code": pick(0), "recommended_action": pick(1), "requires_human_review": pick(2)}
    )


def community_tier(policy: str = "v4", rank: str = "rank", size: str = "community_size") -> F.Column:
    """Tier from rank and community size; only a real community reaches CRITICAL."""
    critical, high, medium = COMMUNITY_POLICIES[policy]
    r, s = F.col(rank), F.coalesce(F.col(size), F.lit(0))
    return (
        F.when((r <= critical) & (s >= 4), "CRITICAL").when(r <= high, "HIGH")
        .when(r <= medium, "MEDIUM").otherwise("LOW")
    )


def action_violations(actions: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row of violation counts of the action table."""
    text = F.lower("recommended_action")
    bad = F.lit(False)
    for phrase in FORBIDDEN_PHRASES:
        bad = bad | text.contains(phrase)
    human = text.contains("human review") | text.contains("human approval")
    one = F.lit(1).alias("one")
    own = actions.agg(
        F.count_if(~F.col("risk_tier").isin(TIERS)).alias("unknown_tier"),
        (F.count("*") - F.countDistinct("account_id")).alias("repeated_accounts"),
        F.count_if(F.col("recommended_action").isNull()).alias("missing_action"),
        F.count_if(bad).alias("forbidden_phrase"),
        F.count_if((F.col("risk_tier") == "CRITICAL") & ~human).alias("critical_without_human"),
        one,
    )
    lost = flagged.join(actions, "account_id", "left_anti").agg(F.count("*").alias("uncovered_accounts"), one)
    return own.join(lost, "one").drop("one")


def queue_page(queue: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` rows by rank."""
    return queue.orderBy("rank").limit(limit)


# ------------------------------------------------------------------ evidence
def evidence_gap(flagged: DataFrame, disputes: DataFrame) -> DataFrame:
    """Latest dispute per flagged account: six fields as text, and how many are missing.

    The latest row (larger dispute_id on equal times) comes from ``max_by``, which folds
    map-side, not from a per-account sort. ``disputes`` is already cut off.
    """
    row = F.struct(*[truthy(c).alias(c) for c in EVIDENCE_FIELDS])
    latest = (
        disputes.join(flagged.select("account_id"), "account_id", "left_semi")
        .groupBy("account_id")
        .agg(F.max_by(row, F.struct("dispute_created_at", "dispute_id")).alias("d"))
    )
    j = flagged.select("account_id").join(latest, "account_id", "left")
    has = F.col("d").isNotNull()
    missing = sum(((~F.col(f"d.{c}")).cast("bigint") for c in EVIDENCE_FIELDS), F.lit(0).cast("bigint"))
    return j.select(
        "account_id",
        has.alias("has_dispute_at_cutoff"),
        *[F.when(has, F.col(f"d.{c}").cast("string")).otherwise("NO_DISPUTE_YET").alias(c) for c in EVIDENCE_FIELDS],
        F.when(has, missing).alias("missing_evidence_count"),
    )


# ------------------------------------------------------------------ links
def links_of(flagged: DataFrame, edges: DataFrame) -> DataFrame:
    """(account_id, linked_account, edge_type, weight) for the given accounts."""
    f = flagged.select(F.col("account_id").alias("src"))
    return both_directions(edges).join(f, "src", "left_semi").select(
        F.col("src").alias("account_id"), F.col("dst").alias("linked_account"), "edge_type", "weight"
    )


def graph_evidence(flagged: DataFrame, edges: DataFrame) -> DataFrame:
    """Link totals and the strongest link; equal weights resolve to the first pair."""
    links = links_of(flagged, edges)
    order = F.struct(
        -F.col("weight"), F.least("account_id", "linked_account"), F.greatest("account_id", "linked_account")
    )
    per = links.groupBy("account_id").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("edge_type", "weight"), order).alias("s"),
        *[F.count_if(F.col("edge_type") == t).alias(a) for t, a in (
            ("shares_device", "n_device"), ("shares_ip_prefix", "n_ip"), ("shares_coupon", "n_coupon"))],
    )
    zero = F.lit(0).cast("bigint")
    return flagged.select("account_id").join(per, "account_id", "left").select(
        "account_id",
        F.coalesce("n", zero).alias("total_graph_links"),
        F.col("s.edge_type").alias("strongest_edge_type"),
        F.col("s.weight").alias("strongest_edge_weight"),
        F.coalesce("n_device", zero).alias("number_of_device_links"),
        F.coalesce("n_ip", zero).alias("number_of_ip_links"),
        F.coalesce("n_coupon", zero).alias("number_of_coupon_links"),
    )


def numbered_links(flagged: DataFrame, edges: DataFrame) -> DataFrame:
    """Links numbered per account in edge-table order, with their text form."""
    links = links_of(flagged, edges)
    order = [F.least("account_id", "linked_account").asc(), F.greatest("account_id", "linked_account").asc()]
    out = ranked(links, order, ["account_id"], "link_no")
    return out.withColumn("link_text", F.concat("edge_type", F.lit(" -> "), F.col("linked_account").cast("string")))


def link_pages(numbered: DataFrame, page_size: int = PAGE_LINKS) -> DataFrame:
    """``"type -> account | ..."`` text in pages."""
    page = F.floor((F.col("link_no") - 1) / F.lit(page_size)).cast("int")
    item = F.struct("link_no", "link_text")
    return numbered.groupBy("account_id", page.alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["link_text"]), " | ").alias("linked_accounts")
    )


def parse_links(pages: DataFrame) -> DataFrame:
    """Link text back to rows: (account_id, page, position, edge_type, linked_account)."""
    parts = F.filter(
        F.transform(F.split("linked_accounts", r"\|"), lambda x: F.trim(x)), lambda x: x.contains("->")
    )
    rows = pages.select("account_id", "page", F.posexplode(parts).alias("position", "rel"))
    return rows.select(
        "account_id", "page", "position",
        F.trim(F.substring_index("rel", "->", 1)).alias("edge_type"),
        F.trim(F.expr("substring(rel, instr(rel, '->') + 2)")).alias("linked_account"),
    )


def link_explanations(evidence: DataFrame, parsed: DataFrame) -> DataFrame:
    """Strongest link's first target and a sentence about it."""
    firsts = parsed.groupBy("account_id", "edge_type").agg(
        F.min_by("linked_account", F.struct("page", "position")).alias("strongest_edge_target")
    )
    j = evidence.join(
        firsts.withColumnRenamed("edge_type", "strongest_edge_type"), ["account_id", "strongest_edge_type"], "left"
    )
    label = lookup(F.col("strongest_edge_type"), EDGE_LABELS, F.col("strongest_edge_type"))
    weight = F.format_string("%.2f", "strongest_edge_weight")
    close = "weight is an evidence-prioritization heuristic, not proof of abuse."
    with_target = F.concat(
        F.lit("Strongest configured relationship is a "), label, F.lit(" link to "),
        F.col("strongest_edge_target"), F.lit(" (weight "), weight, F.lit("). The "), F.lit(close),
    )
    without = F.concat(
        F.lit("Strongest configured relationship is "), label, F.lit(" (weight "), weight, F.lit("). The "), F.lit(close)
    )
    return j.withColumn(
        "strongest_edge_explanation",
        F.when(F.col("strongest_edge_type").isNull(), F.lit(None).cast("string"))
        .when(F.col("strongest_edge_target").isNotNull(), with_target)
        .otherwise(without),
    )


def ego_edges(flagged: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from each focus account to its neighbors with configured weights."""
    return links_of(flagged, edges).select(
        F.col("account_id").alias("source"), F.col("linked_account").alias("target"), "edge_type",
        lookup(F.col("edge_type"), EDGE_WEIGHTS, F.lit(0.0)).alias("weight"),
    )


def ego_nodes(flagged: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(focus, node, is_focus, community_id): the account itself and its neighbors."""
    own = flagged.select(F.col("account_id").alias("focus"), F.col("account_id").alias("node"), F.lit(True).alias("is_focus"))
    near = links_of(flagged, edges).select(
        F.col("account_id").alias("focus"), F.col("linked_account").alias("node"), F.lit(False).alias("is_focus")
    ).distinct()
    c = communities.withColumnRenamed("account_id", "node")
    return own.unionByName(near).join(c, "node", "left").select("focus", "node", "is_focus", "community_id")


def overview_nodes(flagged: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """All flagged accounts and their neighbors once each; flagged ones are in focus."""
    return ego_nodes(flagged, edges, communities).groupBy("node").agg(
        F.max("is_focus").alias("is_focus"), F.first("community_id").alias("community_id")
    )


# ------------------------------------------------------------------ timeline and money
def timeline(orders: DataFrame, disputes: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Order life events and disputes as rows; no cutoff unless asked."""
    money = lambda c: F.format_string("%.2f", c)
    oid = F.col("order_id").cast("string")

    def event(when, at, name, details, amount):
        return F.when(when, F.struct(F.col(at).alias("timestamp"), F.lit(name).alias("event"), details.alias("details"), amount.alias("amount")))

    none = F.lit(None).cast("double")
    items = F.array(
        event(F.lit(True), "order_timestamp", "Order placed", F.concat(F.lit("Order "), oid, F.lit(", amount ₹"), money("amount")), F.col("amount")),
        event(F.col("delivery_timestamp").isNotNull(), "delivery_timestamp", "Order delivered", F.concat(F.lit("Order "), oid), none),
        event(F.col("return_flag") & F.col("return_timestamp").isNotNull(), "return_timestamp", "Return requested",
              F.concat(F.lit("Order "), oid, F.lit(", reason "), F.col("return_reason_code")), none),
        event(F.col("refund_flag") & F.col("refund_timestamp").isNotNull(), "refund_timestamp", "Refund processed",
              F.concat(F.lit("Order "), oid, F.lit(", amount ₹"), money("refund_amount")), F.col("refund_amount")),
    )
    life = orders.select("account_id", "order_id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("e")).select(
        "account_id", "order_id", "e.timestamp", "e.event", "e.details", "e.amount"
    )
    raised = disputes.select(
        "account_id", "order_id", F.col("dispute_created_at").alias("timestamp"), F.lit("Dispute created").alias("event"),
        F.concat(F.lit("Reason "), F.col("dispute_reason_code")).alias("details"), none.alias("amount"),
    )
    out = life.unionByName(raised)
    return out if cutoff is None else out.filter(F.col("timestamp") <= ts(cutoff))


def sorted_timeline(events: DataFrame) -> DataFrame:
    return events.orderBy("account_id", "timestamp", "event", "order_id")


def timeline_facts(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Return and refund facts re-derived from event rows, amounts read from the text.

    ``totals`` has account_id, total_orders and the observed rates to fall back on.
    """
    amount = F.regexp_replace(F.regexp_extract("details", r"amount\s*₹?\s*([0-9,]+(?:\.[0-9]+)?)", 1), ",", "")
    per = events.groupBy("account_id").agg(
        F.count_if(F.lower("event") == "return requested").alias("returns"),
        F.count_if(F.lower("event") == "refund processed").alias("refunds"),
        F.sum(F.when(F.lower("event") == "refund processed", F.coalesce(amount.try_cast("double"), F.lit(0.0)))).alias("refunded"),
    )
    j = totals.join(per, "account_id", "left")
    has_ret, has_ref = F.coalesce(F.col("returns"), F.lit(0)) > 0, F.coalesce(F.col("refunds"), F.lit(0)) > 0
    rate = lambda n, old: F.when(F.col("total_orders") > 0, F.col(n) / F.col("total_orders")).otherwise(F.col(old))
    return j.select(
        "account_id",
        "total_orders",
        F.when(has_ret, F.col("returns")).otherwise(F.col("total_returns")).alias("total_returns"),
        F.when(has_ret, rate("returns", "return_rate")).otherwise(F.col("return_rate")).alias("return_rate"),
        F.when(has_ref, F.col("refunds")).otherwise(F.col("total_refunds")).alias("total_refunds"),
        F.when(has_ref, F.col("refunded")).otherwise(F.col("total_refund_amount")).alias("total_refund_amount"),
        F.when(has_ref, rate("refunds", "refund_rate")).otherwise(F.col("refund_rate")).alias("refund_rate"),
    )


def exposure(orders: DataFrame) -> DataFrame:
    """Gross order value, refunded amount, and what is left, never below 0."""
    refund = F.when(F.coalesce(F.col("refund_flag"), F.lit(False)), F.coalesce("refund_amount", F.lit(0.0))).otherwise(0.0)
    sums = orders.groupBy("account_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("gross_order_value"), F.sum(refund).alias("refund_amount")
    )
    return sums.withColumn(
        "potential_exposure", F.greatest(F.lit(0.0), F.col("gross_order_value") - F.col("refund_amount"))
    )


def shared_attributes(accounts: DataFrame, features: DataFrame, kinds: list[str]) -> DataFrame:
    """(account_id, attribute, count) for attributes the accounts share with anyone."""
    rows = features.join(accounts.select("account_id"), "account_id", "left_semi").select(
        "account_id",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("attribute"), F.col(f"shared_{k}_count").cast("bigint").alias("count")) for k in kinds
        ])).alias("x"),
    )
    return rows.select("account_id", "x.attribute", "x.count").filter(F.col("count") > 0)


def policy_for(category: F.Column) -> F.Column:
    return lookup(category, POLICIES, F.lit(DEFAULT_POLICY))


# ------------------------------------------------------------------ reports
def report_lines(queue: DataFrame, facts: DataFrame, contributors: DataFrame, links: DataFrame, evidence: DataFrame, n_flagged: int) -> DataFrame:
    """(account_id, section, line_no, line): the case report as ordered rows.

    ``contributors`` has account_id, place, feature, value; ``links`` comes from
    ``numbered_links``; ``facts`` has the behavior columns.
    """
    blank = F.lit("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    fact = lambda n: F.concat(F.lit(f"  {n}: "), text(n))
    real = [f for f in BEHAVIOR_FACTS if f.endswith("_rate")]
    shown = facts.withColumns({c: F.format_string("%.6f", F.col(c)) for c in real})
    head = queue.join(shown, "account_id", "left")
    top = F.array(
        F.concat(F.lit("Account ID: "), F.col("account_id").cast("string")),
        F.concat(F.lit("Risk score: "), F.format_string("%.6f", "proba")),
        F.concat(F.lit("Investigation rank: "), F.col("rank").cast("string"), F.lit(f" / {n_flagged} flagged accounts")),
        blank, F.lit("Observed facts:"), *[fact(n) for n in BEHAVIOR_FACTS],
        blank, F.lit("Top model contributors:"),
    )
    a = head.select("account_id", F.lit(1).alias("section"), F.posexplode(top).alias("line_no", "line"))
    way = F.when(F.col("value") > 0, "increased").otherwise("decreased")
    b = contributors.join(queue.select("account_id"), "account_id", "left_semi").select(
        "account_id", F.lit(2).alias("section"), F.col("place").cast("int").alias("line_no"),
        F.concat(F.lit("  "), F.col("feature"), F.lit(": "), F.format_string("%.6f", "value"), F.lit(" ("), way, F.lit(" model risk)")).alias("line"),
    )
    c = queue.select("account_id", F.lit(3).alias("section"), F.posexplode(F.array(blank, F.lit("Graph evidence:"))).alias("line_no", "line"))
    d = links.select(
        "account_id", F.lit(4).alias("section"), F.col("link_no").cast("int").alias("line_no"),
        F.concat(F.lit("  "), F.col("link_text")).alias("line"),
    )
    lonely = queue.join(links.select("account_id").distinct(), "account_id", "left_anti").select(
        "account_id", F.lit(4).alias("section"), F.lit(0).alias("line_no"), F.lit("  No graph relationships observed.").alias("line")
    )
    has = F.col("has_dispute_at_cutoff")
    field = lambda n: F.concat(F.lit(f"  {n}: "), F.when(F.col(n) == "true", "AVAILABLE").otherwise("MISSING"))
    status = F.when(
        has,
        F.array(
            blank, F.lit("Evidence status:"), *[field(n) for n in EVIDENCE_FIELDS],
            F.concat(F.lit("  Missing evidence count: "), F.coalesce(F.col("missing_evidence_count").cast("string"), F.lit("0"))),
        ),
    ).otherwise(F.array(blank, F.lit("Evidence status:"), F.lit("  No dispute observed at prediction cutoff.")))
    e = evidence.join(queue.select("account_id"), "account_id", "left_semi").select(
        "account_id", F.lit(5).alias("section"), F.posexplode(status).alias("line_no", "line")
    )
    f = queue.select(
        "account_id", F.lit(6).alias("section"),
        F.posexplode(F.array(blank, F.lit("Recommended action:"), F.concat(F.lit("  "), F.col("recommended_action")))).alias("line_no", "line"),
    )
    out = a
    for part in (b, c, d, lonely, e, f):
        out = out.unionByName(part)
    return out


def report_pages(lines: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """(account_id, page, case_report_text); all but hub accounts fit on page 0."""
    n = ranked(lines, [F.col("section").asc(), F.col("line_no").asc()], ["account_id"], "n")
    page = F.floor((F.col("n") - 1) / F.lit(page_lines)).cast("int")
    return n.groupBy("account_id", page.alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("case_report_text")
    )


def report_violations(pages: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: reports, missing reports, empty texts, reports without an action line."""
    per = pages.groupBy("account_id").agg(
        F.max(F.col("case_report_text").isNull()).alias("empty"),
        F.max(F.col("case_report_text").contains("Recommended action:")).alias("acts"),
    )
    j = queue.select("account_id", F.lit(1).alias("q")).join(per, "account_id", "full")
    return j.agg(
        F.count("acts").alias("n_reports"),
        F.count_if(F.col("acts").isNull()).alias("missing_reports"),
        F.count_if(F.col("q").isNull()).alias("unexpected_reports"),
        F.count_if(F.col("empty")).alias("empty_reports"),
        F.count_if(~F.col("acts")).alias("without_action"),
    )


def top_contributors(attributions: DataFrame, n: int = 5) -> DataFrame:
    """(account_id, feature, value) -> the n largest by absolute value with direction."""
    w = Window.partitionBy("account_id").orderBy(F.abs("value").desc(), F.col("feature").asc())
    # One row per feature, so a partition is as wide as the feature list.
    return attributions.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).withColumn(
        "direction", F.when(F.col("value") > 0, "increased").otherwise("decreased")
    )


def investigation_summary(queue: DataFrame, edges: DataFrame, shared: DataFrame, evidence: DataFrame, events: DataFrame, money: DataFrame) -> DataFrame:
    """Counts per investigated account and the short text of each data tool."""
    q = queue.select("account_id")
    n_links = links_of(q, edges).groupBy("account_id").agg(F.count("*").alias("linked_accounts"))
    n_shared = shared.groupBy("account_id").agg(F.count("*").alias("shared_attributes"))
    n_events = events.join(q, "account_id", "left_semi").groupBy("account_id").agg(F.count("*").alias("timeline_events"))
    available = sum(((F.col(c) == "true").cast("bigint") for c in EVIDENCE_FIELDS), F.lit(0).cast("bigint"))
    missing = sum(((F.col(c) == "false").cast("bigint") for c in EVIDENCE_FIELDS), F.lit(0).cast("bigint"))
    ev = evidence.select("account_id", "has_dispute_at_cutoff", available.alias("evidence_available"), missing.alias("evidence_missing"))
    j = q.join(n_links, "account_id", "left").join(n_shared, "account_id", "left").join(n_events, "account_id", "left")
    j = j.join(ev, "account_id", "left").join(money, "account_id", "left")
    zero = F.lit(0).cast("bigint")
    counts = ["linked_accounts", "shared_attributes", "timeline_events", "evidence_available", "evidence_missing"]
    amounts = ["gross_order_value", "refund_amount", "potential_exposure"]
    j = j.withColumns({**{c: F.coalesce(F.col(c), zero) for c in counts}, **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in amounts}})
    say = lambda c: F.format_string("%,.0f", F.col(c))
    return j.select(
        "account_id", *counts, *amounts,
        F.concat(F.col("linked_accounts").cast("string"), F.lit(" linked accounts")).alias("links_text"),
        F.concat(F.col("shared_attributes").cast("string"), F.lit(" shared attributes across categories")).alias("shared_text"),
        F.when(F.coalesce(F.col("has_dispute_at_cutoff"), F.lit(False)),
               F.concat(F.col("evidence_available").cast("string"), F.lit(" available, "), F.col("evidence_missing").cast("string"), F.lit(" missing")))
        .otherwise("no dispute at cutoff").alias("evidence_text"),
        F.concat(F.col("timeline_events").cast("string"), F.lit(" timeline events")).alias("timeline_text"),
        F.concat(F.lit("GMV ₹"), say("gross_order_value"), F.lit(", refund ₹"), say("refund_amount"), F.lit(", exposure ₹"), say("potential_exposure")).alias("exposure_text"),
    )


# ------------------------------------------------------------------ narratives
CLAIM = r"₹\s*([0-9]+(?:\.[0-9]+)?)"
NEUTRAL_SUMMARY = (
    "The investigation identified relevant account, graph, evidence, and policy signals. "
    "Authoritative financial values are shown separately from the AI-generated investigation narrative."
)
NARRATIVE_LISTS = ["key_findings", "evidence_gaps", "uncertainties"]


def check_claims(narratives: DataFrame, money: DataFrame, events: DataFrame) -> DataFrame:
    """Drop monetary statements of narratives that name an amount nobody can confirm.

    Claims and confirmed amounts meet as rows in an anti-join on (account, amount), so the
    confirmed amounts of a busy account are never gathered into one set.
    """
    texts = F.concat(F.array("summary"), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in NARRATIVE_LISTS])
    said = narratives.select("account_id", F.explode(texts).alias("t")).select(
        "account_id", F.explode(F.regexp_extract_all("t", F.lit(CLAIM), 1)).alias("a")
    )
    said = said.select("account_id", F.round(F.col("a").cast("double"), 2).alias("amount")).distinct()
    own = money.select(
        "account_id", F.explode(F.array("gross_order_value", "refund_amount", "potential_exposure")).alias("a")
    ).select("account_id", F.round("a", 2).alias("amount"))
    seen = events.select("account_id", F.explode(F.regexp_extract_all("details", F.lit(CLAIM), 1)).alias("a")).select(
        "account_id", F.round(F.col("a").cast("double"), 2).alias("amount")
    )
    unconfirmed = (
        said.join(own.unionByName(seen).distinct(), ["account_id", "amount"], "left_anti")
        .select("account_id", F.lit(True).alias("bad")).distinct()
    )
    j = narratives.join(unconfirmed, "account_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    has_claim = lambda t: t.rlike(CLAIM)
    cleaned = {
        c: F.when(F.col("bad"), F.filter(F.col(c), lambda t: ~has_claim(t))).otherwise(F.col(c)) for c in NARRATIVE_LISTS
    }
    summary = F.when(F.col("bad") & has_claim(F.col("summary")), NEUTRAL_SUMMARY).otherwise(F.col("summary"))
    return j.withColumns({**cleaned, "summary": summary}).withColumnRenamed("bad", "unsupported_claim")


def extract_narrative(df: DataFrame, text: str) -> DataFrame:
    """summary and findings from text that holds JSON somewhere; null when none parses.

    The whole text is tried first, then the span from its first brace to its last. A lone
    string where a list belongs becomes a one-element list.
    """
    whole = F.get_json_object(F.col(text), "$")
    span = F.get_json_object(F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1), "$")
    j = df.withColumn("_json", F.coalesce(whole, span))

    def as_list(name: str) -> F.Column:
        raw = F.get_json_object("_json", f"$.{name}")
        return (
            F.when(raw.isNull(), F.lit(None).cast("array<string>"))
            .when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
            .otherwise(F.array(raw))
        )

    return j.withColumns(
        {"parsed": F.col("_json").isNotNull(), "summary": F.get_json_object("_json", "$.summary"), "key_findings": as_list("key_findings")}
    ).drop("_json")


def account_360(queue: DataFrame, facts: DataFrame, evidence: DataFrame, links: DataFrame, contributors: DataFrame, reports: DataFrame) -> DataFrame:
    """Nested records of the queued accounts, one per account and report page (usually one page)."""
    top = contributors.groupBy("account_id").agg(
        # At most five rows per account.
        F.array_sort(F.collect_list(F.struct("place", "feature", "value", "direction"))).alias("contributors")
    )
    count = reports.groupBy("account_id").agg(F.count("*").alias("report_pages"))
    pages = reports.select("account_id", "page", "case_report_text").join(count, "account_id")
    fact_cols = [c for c in facts.columns if c != "account_id"]
    f = facts.select("account_id", F.struct(*fact_cols).alias("observed_facts"))
    e = evidence.select("account_id", F.struct(*[c for c in evidence.columns if c != "account_id"]).alias("evidence_status"))
    g = links.select("account_id", F.struct(*[c for c in links.columns if c != "account_id"]).alias("graph_evidence"))
    out = queue
    for part in (f, e, g, top, pages):
        out = out.join(part, "account_id", "left")
    return out


def account_record(
    queue: DataFrame, facts: DataFrame, evidence: DataFrame, links: DataFrame, linked: DataFrame, contributors: DataFrame,
    reports: DataFrame, model_version: str = MODEL_VERSION,
) -> DataFrame:
    """``account_360`` with the length of the queue, the model's version and the linked accounts.

    ``linked`` is ``numbered_links``. One row per account and page; a page holds a page of the
    report, of the links, or of both, so neither list grows beyond a page.
    """
    whole = account_360(queue, facts, evidence, links, contributors, reports.filter("page = 0")).drop("page", "case_report_text", "report_pages")
    both = reports.select("account_id", "page", "case_report_text").join(link_pages(linked), ["account_id", "page"], "full")
    total = queue.agg(F.count("*").alias("rank_total"))
    return (
        whole.join(both, "account_id", "left").crossJoin(F.broadcast(total))  # one row
        .withColumn("model_version", F.lit(model_version))
    )
