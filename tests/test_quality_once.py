"""Quality checks that read each table once, against brute force."""

import random
from datetime import datetime, timedelta

from verdigris.operators import investigation as N
from verdigris.operators import quality as Q


def tables(spark):
    rng = random.Random(6)
    day = datetime(2000, 1, 1)
    orders = [
        (rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), f"d{rng.randrange(6)}", rng.choice([True, False, None]), rng.choice([True, False, None]),
         rng.choice(["delivered", "failed", "pending", None]), rng.choice([True, False]), rng.choice([None, day + timedelta(days=1)]))
        for _ in range(90)
    ]
    schema = "order_id INT, account_id INT, device_id STRING, refund_flag BOOLEAN, dispute_flag BOOLEAN, delivery_status STRING, rto_flag BOOLEAN, delivery_timestamp TIMESTAMP"
    refunds = [(rng.choice([None, *range(60)]),) for _ in range(50)]
    disputes = [(rng.choice([None, *range(60)]),) for _ in range(30)]
    accounts = [(k % 9,) for k in range(14)] + [(None,)]
    make = lambda r, s: spark.createDataFrame(r, s)
    return (orders, refunds, disputes, accounts), (make(orders, schema), make(refunds, "order_id INT"), make(disputes, "order_id INT"), make(accounts, "account_id INT"))


def test_orphans(spark):
    (orders, refunds, disputes, accounts), (o, r, s, a) = tables(spark)
    found = Q.orphan_rows([("orders.account", o, "account_id", a, "account_id"), ("refunds.order", r, "order_id", o, "order_id"), ("orders.refund", o, "order_id", r, "order_id"), ("accounts.self", a, "account_id", a, "account_id")])
    lost = lambda child, parent: sum(c is None or c not in parent for c in child)
    order_ids, refund_ids, account_ids = [x[0] for x in orders], [x[0] for x in refunds], [x[0] for x in accounts]
    assert {x.check_name: x.violations for x in found.collect()} == {
        "orders.account": lost([x[1] for x in orders], set(account_ids)), "refunds.order": lost(refund_ids, set(order_ids)),
        "orders.refund": lost(order_ids, set(refund_ids)), "accounts.self": 1,
    }
    none = Q.orphan_rows([("x", o.limit(0), "order_id", r, "order_id")])
    assert [tuple(x) for x in none.collect()] == [("x", 0)]


def test_flags(spark):
    (orders, refunds, disputes, _), (o, r, s, _) = tables(spark)
    joined = lambda marks: [x for (m,) in marks for x in orders if m is not None and x[0] == m]
    found = Q.flag_conflicts(o, r, s)
    assert {x.check_name: x.violations for x in found.collect()} == {
        "refund_without_flag": sum(not x[3] for x in joined(refunds)), "dispute_without_flag": sum(not x[4] for x in joined(disputes)),
        "rto_flag_mismatch": sum(x[5] is not None and (x[5] == "failed") != x[6] for x in orders),
        "undelivered_with_time": sum(x[5] in ("pending", "failed") and x[7] is not None for x in orders),
    }
    assert {x.violations for x in Q.flag_conflicts(o.limit(0), r.limit(0), s.limit(0)).collect()} == {0}


def test_record_pages(spark):
    """An account with more links than a page holds has one row per page, with the queue's length on each."""
    queue = spark.createDataFrame([(1, 0.9, 1, "HIGH"), (2, 0.8, 2, "LOW")], "account_id INT, proba DOUBLE, rank INT, risk_tier STRING")
    n = N.PAGE_LINKS + 3
    linked = spark.createDataFrame([(1, k + 1, 100 + k, f"shares_device -> {100 + k}") for k in range(n)], "account_id INT, link_no BIGINT, linked_account INT, link_text STRING")
    facts = spark.createDataFrame([(1, 5), (2, 6)], "account_id INT, total_orders INT")
    evidence = spark.createDataFrame([(1, True)], "account_id INT, has_dispute_at_cutoff BOOLEAN")
    links = spark.createDataFrame([(1, n)], "account_id INT, total_graph_links INT")
    top = spark.createDataFrame([(1, "return_rate", 0.5, 1, "increased")], "account_id INT, feature STRING, value DOUBLE, place INT, direction STRING")
    reports = spark.createDataFrame([(1, 0, "text"), (2, 0, "other")], "account_id INT, page INT, case_report_text STRING")
    got = {(r.account_id, r.page): r for r in N.account_record(queue, facts, evidence, links, linked, top, reports).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and {r.rank_total for r in got.values()} == {2}
    assert got[1, 0].case_report_text == "text" and got[1, 1].case_report_text is None and got[2, 0].linked_accounts is None
    assert len(got[1, 0].linked_accounts.split(" | ")) == N.PAGE_LINKS and len(got[1, 1].linked_accounts.split(" | ")) == 3
    assert got[1, 1].observed_facts.total_orders == 5 and got[1, 0].model_version == N.MODEL_VERSION
