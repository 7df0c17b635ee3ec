"""Address parsing, blocking and the two scoring paths."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from verdigris.operators import address as R
from verdigris.operators import address_dense


def test_request_examples(spark):
    parts = [("full", {"house_no": "654", "street": "Kale Street", "area": "Sector 50", "city": "Bangalore", "state": "Karnataka", "pin": "560779", "country": "India"}), ("none", {"city": " "})]
    df = spark.createDataFrame(parts, "query_id STRING, parts MAP<STRING,STRING>")
    got = {r["query_id"]: r for r in R.clean_components(df, "parts").collect()}
    assert (got["full"]["city"], got["full"]["state"], got["full"]["pincode"]) == ("bengaluru", "karnataka", "560779")
    assert all(got["none"][f] is None for f in R.FIELDS)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    streets = ["kale", "old mill", "mg", "lake view", "a", "hill"]
    cities = [("Bengaluru", "Karnataka"), ("Pune", "Maharashtra")]
    recs = []
    for i in range(120):
        city, state = cities[0] if rng.random() < 0.7 else cities[1]
        recs.append((i, f"{rng.randrange(1, 30)}, {rng.choice(streets)} Road, Sector {rng.randrange(9)}, {city}, {state} {560000 + rng.randrange(3)}", city, str(560000 + rng.randrange(3))))
    records = spark.createDataFrame(recs, "address_id INT, canonical_address STRING, city STRING, pincode STRING")
    texts = [(i, rng.choice([recs[i][1], recs[i][1][:-7], recs[i][1].lower().replace("road", "rd")])) for i in range(60)]
    queries = spark.createDataFrame(texts, "query_id INT, raw_address STRING")
    q = R.clean_columns(R.parse_raw(queries, "raw_address")).cache()
    r = R.clean_columns(R.parse_canonical(records)).cache()
    return q, r


@pytest.mark.parametrize("dense_pairs,cells", [(0, (7, 11)), (10**9, (512, 2048)), (200, (16, 16))])
def test_dense_cells_equal_the_join(tables, monkeypatch, dense_pairs, cells):
    q, r = tables
    monkeypatch.setattr(address_dense, "QUERY_SLICE", cells[0])
    monkeypatch.setattr(address_dense, "RECORD_SLICE", cells[1])
    cols = ["query_id", "place", "address_id", "score", "exact_count", "strategy"]
    want = rows(R.top_matches(R.block_pairs(q, r)), *cols)
    assert rows(R.best_matches(q, r, dense_pairs=dense_pairs), *cols) == want


@pytest.fixture(scope="module")
def crowded(spark):
    """One city of 3,000 addresses; queries without a pincode, with missing and misspelt parts."""
    rng = random.Random(5)
    streets = [f"{a} {b}" for a in ["old", "new", "lake", "hill", "river", "kale", "mill"] for b in ["view", "cross", "main", "gate", "palace"]]
    values = {
        "house_no": lambda: str(rng.randrange(1, 98)), "street": lambda: f"{rng.choice(streets)} road",
        "area": lambda: f"sector {rng.randrange(1, 61)}", "building": lambda: rng.choice([None, f"{rng.choice(streets)} tower {rng.randrange(40)}"]),
        "pincode": lambda: rng.choice([None, str(411000 + rng.randrange(40))]), "country": lambda: rng.choice([None, "india"]),
    }
    base = [{f: values[f]() if f in values else None for f in R.FIELDS} | {"city": "pune", "state": "maharashtra"} for _ in range(2900)]
    base += [dict(rng.choice(base)) for _ in range(100)]  # equal addresses under other ids
    asked = []
    for _ in range(60):
        mine = {f: v if f == "city" or rng.random() > 0.2 else None for f, v in rng.choice(base).items()} | {"pincode": None}
        if mine["street"] and rng.random() < 0.4:
            mine["street"] = mine["street"].replace("l", "").replace("road", "rd")
        asked.append(mine)
    asked += [{f: "pune" if f == "city" else None for f in R.FIELDS}, {f: {"city": "pune", "street": "zz"}.get(f) for f in R.FIELDS}]
    schema = ", ".join(f"{f} STRING" for f in R.FIELDS)
    r = spark.createDataFrame([(i, None, *b.values()) for i, b in enumerate(base)], f"address_id INT, canonical_address STRING, {schema}")
    q = spark.createDataFrame([(i, *b.values()) for i, b in enumerate(asked)], f"query_id INT, {schema}")
    return q.cache(), r.cache()


def test_crowded_city_scores_few_pairs(crowded):
    q, r = crowded
    cols = ["query_id", "place", "address_id", "score", "exact_count", "strategy"]
    want = rows(R.top_matches(R.block_pairs(q, r)), *cols)
    assert rows(R.best_matches(q, r), *cols) == want
    left, right = q.toPandas().iloc[:60], r.toPandas()
    index = address_dense.AddressIndex(right, R.FIELD_WEIGHTS, R.KINDS, R.STRONG_FIELDS)
    got = index.best(left, 3)
    expect = [(w[0], w[2], w[3], w[4]) for w in want if w[0] < 60]
    assert sorted(zip(got.query_id, got.address_id, got.score, got.exact_count)) == sorted(expect)
    assert index.scored < 0.1 * len(left) * len(right)


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(3)
    values = [k / 2**n for n in (1, 5, 9, 10, 11) for k in range(1, 200)] + [rng.random() for _ in range(2000)] + [(2 * k + 1) * 0.5e-9 for k in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    want = [x[0] for x in df.select(F.round("v", 9)).collect()]
    assert address_dense.round_half_up(np.array(values)).tolist() == want


def test_pair_slices_do_not_change_pairs(tables):
    q, r = tables
    cols = ["query_id", "address_id", "score"]
    assert rows(R.block_pairs(q, r, pairs_per_slice=50), *cols) == rows(R.block_pairs(q, r), *cols)


def test_token_fallback(spark):
    records = spark.createDataFrame([(1, "red mill house"), (2, "red lake"), (3, "blue barn")], "address_id INT, canonical_address STRING")
    asked = spark.createDataFrame([("both", "red mill"), ("one", "red tower"), ("no", "zzz qqq")], "query_id STRING, raw STRING")
    got = rows(R.token_candidates(R.clean_columns(R.parse_raw(asked, "raw")), records), "query_id", "address_id", "strategy")
    assert got == [("both", 1, "token_intersection"), ("one", 1, "token_union"), ("one", 2, "token_union")]


def test_unresolved_and_empty_queries(spark):
    records = spark.createDataFrame([(1, "12, Kale Road, Sector 5, Pune, Maharashtra 560001", "Pune", "560001")], "address_id INT, canonical_address STRING, city STRING, pincode STRING")
    asked = spark.createDataFrame([(1, "some random address"), (2, " "), (3, "12 Kale Rd, Sector 5, Pune 560001")], "query_id INT, raw_address STRING")
    got = {r["query_id"]: r for r in R.resolve(asked, records).collect()}
    assert got[1]["matching_strategy"] == "structured:no_block" and got[1]["requires_human_review"]
    assert got[2]["matching_strategy"] == "structured:no_components" and got[2]["normalized_address"] is None
    assert got[3]["candidate_address_id"] == 1 and got[3]["confidence"] > 0.9


def test_crowded_pairs_compare_values_once(crowded, monkeypatch):
    monkeypatch.setattr(address_dense, "PAIR_QUERIES", 25)
    monkeypatch.setattr(address_dense, "PAIR_RECORDS", 900)
    cols = ["query_id", "address_id", "strategy", "score", "exact_count", *[f"s_{f}" for f in R.FIELDS]]
    every = R.block_pairs(*crowded)
    assert "FlatMapCoGroupsInPandas" in every._jdf.queryExecution().toString()
    joined = R.block_pairs(*crowded, dense_pairs=10**9).select(*cols)
    assert every.count() == joined.count()
    assert every.select(*cols).exceptAll(joined).isEmpty()
