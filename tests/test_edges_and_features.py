"""Edge cases of windows, coupons, merging and behavior features."""

import random
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from verdigris.functions import exprs, skew
from verdigris.operators import bandjoin, behavior, edges, identity, temporal
from verdigris.operators.cleansing import known_at, status_as_of

T = "2000-01-01 00:00:00"
DAY = 86_400_000_000


def brute_pairs(events, window):
    found = set()
    for (k1, a, t1), (k2, b, t2) in combinations(events, 2):
        if k1 == k2 and a != b and abs(t1 - t2) <= window:
            found.add((k1, min(a, b), max(a, b)))
    return found


@pytest.mark.parametrize("cell_rows", [3, 10_000])
def test_close_pairs_match_brute_force(spark, cell_rows):
    rng = random.Random(7)
    # One key holds about a third of the rows.
    events = [(("hot" if rng.random() < 0.35 else f"k{rng.randrange(15)}"), rng.randrange(25), rng.randrange(-300, 300)) for _ in range(400)]
    df = spark.createDataFrame(events, "key STRING, id BIGINT, t BIGINT")
    got = {tuple(r) for r in bandjoin.close_pairs(df, ["key"], "id", "t", 20, cell_rows).distinct().collect()}
    assert got == brute_pairs(events, 20)


@pytest.mark.parametrize("light,cell_rows", [(256, 10_000), (3, 10_000), (256, 4)])
def test_met_once_matches_brute_force(spark, light, cell_rows):
    """First table distinct as it comes, no pair in both, known pairs only in the second; ids with many buckets too."""
    rng = random.Random(light + cell_rows)
    events = [(f"k{rng.randrange(30)}", rng.randrange(60), rng.randrange(-400, 400)) for _ in range(350)]
    events += [("k1", 99, t) for t in range(-400, 400, 15)] + [(None, 1, 5), ("k2", None, 5), ("k2", 4, None)]
    df = spark.createDataFrame(events, "key STRING, id BIGINT, t BIGINT")
    want = {p[1:] for p in brute_pairs([e for e in events if None not in e], 20)}
    known = sorted(want)[::9]
    listed = spark.createDataFrame([*known, (1, 1000)], "id_1 BIGINT, id_2 BIGINT")
    for pairs, inside in ((None, set()), (listed, set(known))):
        once, again = bandjoin.met_once(df, ["key"], "id", "t", 20, pairs, cell_rows, light)
        first, rest = [tuple(r) for r in once.collect()], {tuple(r) for r in again.collect()}
        assert len(first) == len(set(first)) and not set(first) & rest
        assert set(first) | rest == want and inside <= rest
        assert light < 256 or len(first) > len(want) / 3


def test_ip_pairs_are_not_exchanged(spark):
    """Nearly all pairs of a prefix leave the join as they are; only the rest is made distinct."""
    df = spark.createDataFrame([(f"k{i % 7}", i, 5) for i in range(200)], "key STRING, id BIGINT, t BIGINT")
    once, again = bandjoin.met_once(df, ["key"], "id", "t", 100)
    assert once.count() == sum(n * (n - 1) // 2 for n in [29] * 4 + [28] * 3) and again.isEmpty()
    after_join = once._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Aggregate" not in after_join and "Repartition" not in after_join


def test_grid_meets_each_pair_once_in_bounded_cells(spark):
    """Half of all accounts on one entity."""
    left = spark.createDataFrame([("hot" if k % 2 else f"k{k % 40}", k) for k in range(1200)] + [("left", -1), (None, -2)], "key STRING, a BIGINT").cache()
    right = spark.createDataFrame([("hot" if k % 2 else f"k{k % 40}", k) for k in range(900)] + [("right", -1), (None, -2)], "key STRING, b BIGINT").cache()
    l, r, on = skew.grid_sides(left, right, ["key"], "a", "b", 50)
    met = l.join(r, on).select("key", "a", "b")
    want = left.join(right, "key").select("key", "a", "b")
    assert met.count() == want.count() == met.distinct().count() and met.exceptAll(want).isEmpty()
    for side in (l, r):
        assert side.groupBy(*on).count().agg(F.max("count")).first()[0] < 2 * 50
    assert l.filter("key = 'hot'").count() == 600 * 9 and l.filter("key = 'k2'").count() == 30


def test_crowded_entity_in_cells(spark, monkeypatch):
    """Sharers of an entity that half of all accounts use, in cells of a few accounts."""
    monkeypatch.setattr(identity, "CELL", 4)
    orders = [(k, k % 60, 0 if k % 2 else k % 7 + 1, k % 9, f"p{k % 11}", k) for k in range(120)]
    df = spark.createDataFrame(orders, "order_id INT, account_id INT, device_id INT, address_id INT, phone_hash STRING, instrument_id INT")
    whole = rows(identity.sharing_features(identity.stored_links(df)))
    monkeypatch.setattr(identity, "CELL", 10_000)
    assert whole == rows(identity.sharing_features(identity.stored_links(df)))


def test_window_is_inclusive(spark):
    df = spark.createDataFrame([("x", 1, 0), ("x", 2, 100), ("x", 3, 201)], "key STRING, id BIGINT, t BIGINT")
    got = {tuple(r)[1:] for r in bandjoin.close_pairs(df, ["key"], "id", "t", 100).collect()}
    assert got == {(1, 2)}


@pytest.mark.parametrize("hot", [1, 2, 4, 10_000])
def test_sharing_features_exact_for_any_threshold(spark, hot):
    rng = random.Random(hot)
    orders = [
        (i, rng.randrange(18), 0 if rng.random() < 0.33 else rng.randrange(12), rng.randrange(10), f"p{rng.randrange(14)}", rng.randrange(9))
        for i in range(70)
    ]
    df = spark.createDataFrame(orders, "order_id INT, account_id INT, device_id INT, address_id INT, phone_hash STRING, instrument_id INT")
    got = {r["account_id"]: r for r in identity.sharing_features(identity.stored_links(df), hot).collect()}
    users = {}
    for _, acc, *ents in orders:
        for kind, e in zip(identity.KINDS, ents, strict=True):
            users.setdefault((kind, e), set()).add(acc)
    for acc in {o[1] for o in orders}:
        others = {k: set() for k in identity.KINDS}
        for (kind, _), who in users.items():
            if acc in who:
                others[kind] |= who - {acc}
        row = got[acc]
        for k in identity.KINDS:
            assert row[f"shared_{k}_count"] == len(others[k])
        assert row["has_shared_device_and_address"] == int(bool(others["device"] & others["address"]))
        assert row["has_shared_payment_and_phone"] == int(bool(others["instrument"] & others["phone"]))
        assert row["shared_entity_types_count"] == sum(bool(v) for v in others.values())


def test_one_edge_keeps_strongest_type(spark):
    raw = spark.createDataFrame(
        [(1, 2, "shares_phone"), (1, 2, "shares_device"), (3, 4, "shares_ip_prefix"), (3, 4, "shares_address")],
        "account_id_1 INT, account_id_2 INT, edge_type STRING",
    )
    got = rows(edges.merge_evidence(raw))
    assert got == [
        (1, 2, "shares_device", 1.0, ["shares_device", "shares_phone"]),
        (3, 4, "shares_address", 0.7, ["shares_address", "shares_ip_prefix"]),
    ]


def test_rare_coupon_is_under_ten_rows(spark):
    data = [(i, i, "nine") for i in range(9)] + [(100 + i, i, "ten") for i in range(10)] + [(200, 1, " "), (201, 2, " "), (202, 3, None)]
    df = spark.createDataFrame(data, "order_id INT, account_id INT, coupon_code STRING")
    assert edges.coupon_edges(df).count() == 36
    counts = dict(rows(behavior.rare_coupon_counts(df)))
    assert counts[1] == 2 and counts[0] == 1 and 9 not in counts  # blank text is a code here, not for edges


def test_cutoff_and_status(spark):
    df = spark.createDataFrame(
        [(1, T, "delivered", T), (2, "2000-01-01 00:00:01", "delivered", T), (3, None, "x", None), (4, T, "failed", T), (5, T, "delivered", "2000-01-02 00:00:00"), (6, T, "pending", None)],
        "id INT, at STRING, delivery_status STRING, d STRING",
    ).select("id", F.col("at").cast("timestamp").alias("at"), "delivery_status", F.col("d").cast("timestamp").alias("delivery_timestamp"))
    got = rows(known_at(df, "at", T).select("id", status_as_of(T).alias("s")))
    assert got == [(1, "delivered"), (4, "failed"), (5, "pending"), (6, "pending")]


def test_order_windows_open_at_start(spark):
    df = spark.createDataFrame([(1, "1999-12-31 00:00:00"), (1, "1999-12-31 00:00:01"), (1, T)], "account_id INT, s STRING").select(
        "account_id", F.col("s").cast("timestamp").alias("order_timestamp"), F.lit(False).alias("return_flag"), F.lit(None).cast("timestamp").alias("return_timestamp")
    )
    row = df.groupBy("account_id").agg(*temporal.order_time_aggregates(T)).first()
    assert row["orders_last_24h"] == 2 and row["orders_last_7d"] == 3


def test_creation_bursts_match_brute_force(spark):
    rng = random.Random(3)
    hour = 3_600_000_000
    base = 915_148_800_000_000
    times = {i: base + rng.choice([0, hour, 2 * hour, hour // 2, rng.randrange(6 * hour)]) for i in range(60)}
    times[60] = 957_000_000_000_000  # after the cutoff
    df = spark.createDataFrame(list(times.items()), "account_id INT, us BIGINT").select("account_id", F.timestamp_micros("us").alias("account_created_at"))
    got = dict(rows(temporal.creation_bursts(df, T)))
    cut = 946_684_800_000_000
    for i, t in times.items():
        want = sum(1 for j, u in times.items() if j != i and t <= cut and u <= cut and abs(t - u) <= hour)
        assert got[i] == want


def test_text_rules(spark):
    df = spark.createDataFrame([("Yes ",), ("missing",), (None,), ("",), ("on file",), ("0.0",)], "v STRING")
    assert [r[0] for r in df.select(exprs.truthy("v")).collect()] == [True, False, False, False, True, False]
    mails = spark.createDataFrame([("ab@x",), ("abc@x",), ("nox",), (None,)], "m STRING")
    assert [r[0] for r in mails.select(exprs.mask_email("m")).collect()] == ["**@x", "a***c@x", "***", None]
    phones = spark.createDataFrame([("+91 98-7654",), ("12a",), (None,)], "p STRING")
    assert [r[0] for r in phones.select(exprs.mask_contact("p")).collect()] == ["***7654", "***", None]
