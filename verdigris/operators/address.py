"""Address resolution as a batch join: parse both sides, block, score, rank, decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import address_text as A
from verdigris.functions.exprs import non_null_array
from verdigris.functions.skew import grid_sides
from verdigris.operators.address_dense import all_in_cells, dense_matches
from verdigris.session import materialize

# Weight of each component in the match score.
FIELD_WEIGHTS = {
    "pincode": 0.35, "city": 0.15, "area": 0.15, "street": 0.10, "building": 0.10, "house_no": 0.10,
    "state": 0.05, "district": 0.03, "country": 0.02, "landmark": 0.05,
}
# Other names under which components arrive.
FIELD_ALIASES = {
    "flat": "house_no", "flat_no": "house_no", "flat_number": "house_no", "house": "house_no",
    "house_number": "house_no", "hno": "house_no", "building_name": "building", "street_name": "street",
    "road": "street", "locality": "area", "neighborhood": "area", "neighbourhood": "area",
    "pin": "pincode", "postal_code": "pincode", "zip": "pincode",
}
FIELDS = list(FIELD_WEIGHTS)
STRONG_FIELDS = ["pincode", "city", "house_no", "building"]
TOKEN_FIELDS = ["city", "state", "district", "country"]
GRAM_FIELDS = ["area", "street", "building", "house_no", "landmark"]
# Order of components in a written address.
WRITTEN_ORDER = [
    "house_no", "building", "street", "area", "landmark", "city", "district", "state", "pincode", "country",
]
STRATEGIES = ["pincode+city", "pincode", "city+state", "city"]


# ------------------------------------------------------------------ parsing
def _null() -> Column:
    return F.lit(None).cast("string")


def parse_raw(df: DataFrame, text: str) -> DataFrame:
    """Add the ten component columns read from free text."""
    out = df.withColumn("_t", A.expand(A.basic(F.col(text))))
    out = out.withColumns(
        {
            "house_no": A.house_number(F.col("_t")), "street": A.street(F.col("_t")),
            "city": A.detect(F.col("_t"), A.CITY_ALIASES), "state": A.detect(F.col("_t"), A.STATE_ALIASES),
            "country": A.country(F.col("_t")), "pincode": A.pincode(F.col("_t")),
            "district": _null(), "landmark": _null(),
        }
    )
    removed = [F.col(c) for c in ("pincode", "city", "state", "country", "street", "house_no")]
    return _area_and_building(out.withColumn("_r", A.without(F.col("_t"), removed))).drop("_t", "_r")


def _area_and_building(df: DataFrame) -> DataFrame:
    out = df.withColumn("_a", A.without(F.col("_r"), [F.col("street")]))
    out = out.withColumn("area", A.area(F.col("_a")))
    building = A.without(F.col("_r"), [F.col("street"), F.col("area"), F.col("house_no")])
    return out.withColumn("building", A.none_if_blank(F.left(building, F.lit(120)))).drop("_a")


def parse_canonical(df: DataFrame, text: str = "canonical_address", city: str = "city", pin: str = "pincode") -> DataFrame:
    """Add the ten component columns of a stored address; its own city and pincode win."""
    out = df.withColumns(
        {
            "_t": A.expand(A.basic(F.col(text))),
            "_city": A.none_if_blank(A.alias(F.col(city), A.CITY_ALIASES)),
            "_pin": A.clean_pincode(F.col(pin)),
        }
    )
    out = out.withColumns(
        {
            "house_no": A.house_number(F.col("_t")), "street": A.street(F.col("_t")),
            "city": F.coalesce("_city", A.detect(F.col("_t"), A.CITY_ALIASES)),
            "state": A.detect(F.col("_t"), A.STATE_ALIASES), "country": A.country(F.col("_t")),
            "pincode": F.coalesce("_pin", A.pincode(F.col("_t"))), "district": _null(), "landmark": _null(),
        }
    )
    removed = [F.col("pincode"), F.col("city"), F.col("state"), F.lit("india"), F.col("house_no")]
    out = _area_and_building(out.withColumn("_r", A.without(F.col("_t"), removed)))
    segments = F.filter(F.transform(F.split(F.col(text), "[,;|]+"), A.basic), lambda s: F.length(s) > 0)
    taken = F.array(*[F.coalesce(c, F.lit("")) for c in ("city", "state", "pincode")])
    usable = F.filter(
        segments, lambda s: ~F.array_contains(taken, s) & ~s.rlike(r"^(?:house|flat|hno)\s*\w+$")
    )
    return out.withColumn("building", F.coalesce("building", F.try_element_at(usable, F.lit(1)))).drop("_t", "_r", "_city", "_pin")


def clean_value(field: str, c: Column) -> Column:
    """One component in comparable form, null when nothing is left."""
    if field == "pincode":
        out = A.clean_pincode(c)
    elif field == "city":
        out = A.alias(c, A.CITY_ALIASES)
    elif field == "state":
        out = A.alias(c, A.STATE_ALIASES)
    elif field == "country":
        out = A.canonical_country(c)
    elif field == "house_no":
        out = A.canonical_house(c)
    else:
        out = A.expand(A.basic(c))
    return A.none_if_blank(out)


def clean_components(df: DataFrame, components: str) -> DataFrame:
    """Ten cleaned columns from a map of loosely named parts; the last filled name wins."""
    entries = F.map_entries(components)

    def pick(field: str) -> Column:
        names = [field, *[k for k, v in FIELD_ALIASES.items() if v == field]]
        filled = F.filter(entries, lambda e: e["key"].isin(names) & (F.length(F.trim(e["value"])) > 0))
        return F.try_element_at(filled, F.lit(-1))["value"]

    return df.withColumns({f: pick(f) for f in FIELDS}).withColumns({f: clean_value(f, F.col(f)) for f in FIELDS})


def clean_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({f: clean_value(f, F.col(f)) for f in FIELDS})


def written(columns: list[str] | None = None) -> Column:
    return F.concat_ws(", ", *[F.col(c) for c in (columns or WRITTEN_ORDER)])


# ------------------------------------------------------------------ blocking
def _keys() -> Column:
    key = lambda *cols: F.concat_ws("|", *[F.col(c) for c in cols])
    have = lambda *cols: ~F.greatest(*[F.col(c).isNull() for c in cols], F.lit(False))
    levels = [("pincode", "city"), ("pincode",), ("city", "state"), ("city",)]
    return non_null_array(
        [F.when(have(*cols), F.struct(F.lit(i).alias("level"), key(*cols).alias("key"))) for i, cols in enumerate(levels)]
    )


def block_keys(df: DataFrame, id_col: str) -> DataFrame:
    """(id, level, key): the location keys a row can be found by, strongest level 0."""
    return df.select(id_col, F.explode(_keys()).alias("k")).select(id_col, "k.level", "k.key")


def chosen_blocks(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, level, key): each query's strongest location key that holds any address."""
    filled = block_keys(records, "address_id").select("level", "key").distinct()
    return (
        block_keys(queries, "query_id").join(filled, ["level", "key"], "left_semi")
        .groupBy("query_id").agg(F.min_by(F.struct("level", "key"), F.col("level")).alias("b"))
        .select("query_id", "b.level", "b.key")
    )


def query_tokens(df: DataFrame) -> Column:
    """Distinct words of all clean components but the pincode."""
    parts = [F.coalesce(A.word_set(F.col(f)), F.array().cast("array<string>")) for f in FIELDS if f != "pincode"]
    return F.array_distinct(F.flatten(F.array(*parts)))


def token_candidates(queries: DataFrame, records: DataFrame, text: str = "canonical_address", rarest: int = 5) -> DataFrame:
    """(query_id, address_id, strategy) for queries without a location block.

    The rarest tokens of the query (unknown tokens count as rarest) must all occur; if no
    address has them all, any of them will do. No list is cut.
    """
    asked = queries.select("query_id", F.explode(query_tokens(queries)).alias("token"))
    postings = records.select("address_id", F.explode(A.tokens(F.col(text))).alias("token"))
    postings = postings.join(asked.select("token").distinct(), "token", "left_semi")
    frequency = postings.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy(F.col("df").asc(), F.col("token").asc())
    # One partition is one query's own tokens.
    ranked = (
        asked.join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("bigint")))
        .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rarest)
    )
    wanted = ranked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    left, right, on = grid_sides(ranked.select("query_id", "token"), postings, ["token"], "query_id", "address_id")
    hits = left.join(right, on).groupBy("query_id", "address_id").agg(F.count("*").alias("hits"))
    hits = materialize(hits.join(wanted, "query_id"), "token-hits")
    full = hits.filter("hits = wanted").select("query_id").distinct()
    all_of = hits.filter("hits = wanted").select("query_id", "address_id", F.lit("token_intersection").alias("strategy"))
    any_of = hits.join(full, "query_id", "left_anti").select("query_id", "address_id", F.lit("token_union").alias("strategy"))
    return all_of.unionByName(any_of)


# ------------------------------------------------------------------ scoring
def _side(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Clean component values with their words and trigrams, computed once per row."""
    cols = [F.col(c) for c in keep]
    cols += [F.col(f).alias(f"{prefix}{f}") for f in FIELDS]
    cols += [A.word_set(F.col(f)).alias(f"{prefix}{f}_tok") for f in TOKEN_FIELDS + GRAM_FIELDS]
    cols += [A.trigrams(F.col(f)).alias(f"{prefix}{f}_tri") for f in GRAM_FIELDS]
    cols += [F.replace(F.col(f), F.lit(" "), F.lit("")).alias(f"{prefix}{f}_flat") for f in GRAM_FIELDS]
    return df.select(*cols)


def _overlaps() -> dict[str, Column]:
    """Shared words and trigrams per field, only where both values exist and differ."""
    out = {}
    for f in TOKEN_FIELDS + GRAM_FIELDS:
        differ = F.col(f"q_{f}") != F.col(f"r_{f}")
        out[f"w_{f}"] = F.when(differ, F.size(F.array_intersect(f"q_{f}_tok", f"r_{f}_tok")))
        if f in GRAM_FIELDS:
            out[f"g_{f}"] = F.when(differ, F.size(F.array_intersect(f"q_{f}_tri", f"r_{f}_tri")))
    return out


def _share(both: Column, a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def similarity(field: str) -> Column:
    """Similarity of one component from its overlaps; null when either side lacks it."""
    left, right = F.col(f"q_{field}"), F.col(f"r_{field}")
    if field == "pincode":
        score = F.lit(0.0)
    else:
        score = _share(F.col(f"w_{field}"), F.col(f"q_{field}_tok"), F.col(f"r_{field}_tok"))
    if field in GRAM_FIELDS:
        gram = F.when(F.col(f"q_{field}_flat") == F.col(f"r_{field}_flat"), 1.0).otherwise(
            _share(F.col(f"g_{field}"), F.col(f"q_{field}_tri"), F.col(f"r_{field}_tri"))
        )
        inside = (left.contains(right) | right.contains(left)).cast("double")
        score = F.least(F.lit(1.0), 0.55 * score + 0.30 * gram + 0.15 * inside)
    return F.when(left == right, 1.0).when(left != right, score)


def scored(pairs: DataFrame) -> DataFrame:
    """Add s_* similarities, ``score`` and ``exact_count`` to prepared pairs."""
    out = pairs.withColumns(_overlaps()).withColumns({f"s_{f}": similarity(f) for f in FIELDS})
    zero = F.lit(0.0)
    got = sum((F.coalesce(F.col(f"s_{f}") * w, zero) for f, w in FIELD_WEIGHTS.items()), zero)
    weight = sum((F.when(F.col(f"s_{f}").isNotNull(), w).otherwise(0.0) for f, w in FIELD_WEIGHTS.items()), zero)
    exact = lambda fs: sum((F.coalesce((F.col(f"s_{f}") >= 0.999).cast("int"), F.lit(0)) for f in fs), F.lit(0))
    base = F.when(weight > 0, got / weight).otherwise(0.0)
    strong = exact(STRONG_FIELDS) >= 2
    return out.withColumns(
        {
            "score": F.round(F.when(strong & (weight > 0), F.least(F.lit(1.0), base + 0.04)).otherwise(base), 9),
            "exact_count": exact(FIELDS),
        }
    )


PAIRS_PER_SLICE = 100_000


def _sliced(chosen: DataFrame, placed: DataFrame, pairs_per_slice: int) -> tuple[DataFrame, DataFrame, int]:
    """Add ``slice`` to both sides so that each slice is about one task's worth of pairs.

    Scoring dominates, so slices follow the number of pairs of a block, not its bytes. A block
    with more pairs than one slice holds splits its queries; its addresses go to every slice.
    """
    nq = chosen.groupBy("level", "key").agg(F.count("*").alias("nq"))
    nr = placed.groupBy("level", "key").agg(F.count("*").alias("nr"))
    blocks = nq.join(nr, ["level", "key"]).withColumn("pairs", F.col("nq") * F.col("nr"))
    slices = F.least(F.col("nq"), F.ceil(F.col("pairs") / F.lit(pairs_per_slice))).cast("int")
    blocks = materialize(blocks.withColumn("slices", slices), "blocks")
    total = blocks.agg(F.sum("pairs")).first()[0] or 0
    sizes = blocks.select("level", "key", "slices")
    left = chosen.join(sizes, ["level", "key"]).withColumn(
        "slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")
    )
    right = placed.join(sizes, ["level", "key"]).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )
    return left.drop("slices"), right.drop("slices"), total


def _blocks(queries: DataFrame, records: DataFrame, dense_pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Block of each query, blocks of each address that any query asks, and sizes with the crowded ones marked."""
    chosen = materialize(chosen_blocks(queries, records), "chosen")
    placed = block_keys(records, "address_id").join(chosen.select("level", "key").distinct(), ["level", "key"], "left_semi")
    placed = materialize(placed, "placed")
    sizes = chosen.groupBy("level", "key").agg(F.count("*").alias("nq")).join(
        placed.groupBy("level", "key").agg(F.count("*").alias("nr")), ["level", "key"]
    )
    return chosen, placed, materialize(sizes.withColumn("dense", F.col("nq") * F.col("nr") > dense_pairs), "sizes")


def _sides(chosen: DataFrame, placed: DataFrame, sizes: DataFrame, dense: bool) -> tuple[DataFrame, DataFrame]:
    blocks = sizes.filter(F.col("dense") == dense).select("level", "key")
    return chosen.join(blocks, ["level", "key"], "left_semi"), placed.join(blocks, ["level", "key"], "left_semi")


def _strategy() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("level") + 1).alias("strategy")


DENSE_PAIRS = 2_000
KINDS = {**{f: "grams" for f in GRAM_FIELDS}, **{f: "words" for f in TOKEN_FIELDS}, "pincode": "exact"}


def block_pairs(
    queries: DataFrame, records: DataFrame, text: str = "canonical_address", pairs_per_slice: int = PAIRS_PER_SLICE,
    dense_pairs: int = DENSE_PAIRS,
) -> DataFrame:
    """Scored (query_id, address_id) pairs of each query's block, with the strategy.

    Both inputs carry clean components (``clean_columns``) and should be stored tables. In
    blocks of more than ``dense_pairs`` pairs distinct component values are compared once per
    cell (``address_dense``); all their pairs are rows all the same.
    """
    chosen, placed, sizes = _blocks(queries, records, dense_pairs)
    q = _side(queries, "q_", ["query_id"])
    r = _side(records, "r_", ["address_id"])
    left, right, total = _sliced(*_sides(chosen, placed, sizes, False), pairs_per_slice)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n = max(cores, -(-total // pairs_per_slice))
    on = ["level", "key", "slice"]
    left = left.join(q, "query_id").repartition(n, *on)
    right = right.join(r, "address_id").repartition(n, *on)
    met = left.hint("shuffle_hash").join(right, on)
    out = scored(met.withColumn("strategy", _strategy()))
    out = out.select("query_id", "address_id", "strategy", "score", "exact_count", *[f"s_{f}" for f in FIELDS])
    if not sizes.filter("dense").isEmpty():
        many_q, many_r = _sides(chosen, placed, sizes, True)
        crowded = all_in_cells(
            many_q.join(queries.select("query_id", *FIELDS), "query_id"),
            many_r.join(records.select("address_id", *FIELDS), "address_id"),
            sizes.filter("dense"), FIELD_WEIGHTS, KINDS, STRONG_FIELDS,
        )
        out = out.unionByName(crowded.withColumn("strategy", _strategy()).select(*out.columns))
    open_queries = queries.join(chosen, "query_id", "left_anti")
    if open_queries.isEmpty():
        return out
    by_token = token_candidates(open_queries, records, text)
    token_pairs = scored(by_token.join(q, "query_id").join(r, "address_id"))
    return out.unionByName(token_pairs.select(*out.columns))


def top_matches(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Best n candidates per query; each task keeps only its own n before the exchange."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("exact_count").desc(), F.col("address_id").asc())
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def best_matches(
    queries: DataFrame, records: DataFrame, n: int = 3, dense_pairs: int = DENSE_PAIRS, text: str = "canonical_address"
) -> DataFrame:
    """Top n addresses per query: the result of ``top_matches(block_pairs(...))``.

    Blocks with more than ``dense_pairs`` pairs are answered cell by cell from posting lists
    (``address_dense``), which score a small part of the pairs; their pairs never become rows.
    Small blocks and token candidates stay in the join. Scores are alike to the last digit.
    """
    chosen, placed, sizes = _blocks(queries, records, dense_pairs)
    cols = ["query_id", "address_id", "strategy", "score", "exact_count"]
    few_q, few_r = _sides(chosen, placed, sizes, False)
    q = _side(queries, "q_", ["query_id"])
    r = _side(records, "r_", ["address_id"])
    found = scored(
        few_q.join(q, "query_id").join(few_r.join(r, "address_id"), ["level", "key"]).withColumn("strategy", _strategy())
    ).select(*cols)
    if not sizes.filter("dense").isEmpty():
        many_q, many_r = _sides(chosen, placed, sizes, True)
        winners = dense_matches(
            many_q.join(queries.select("query_id", *FIELDS), "query_id"),
            many_r.join(records.select("address_id", *FIELDS), "address_id"),
            sizes.filter("dense"), FIELD_WEIGHTS, KINDS, STRONG_FIELDS, n,
        )
        found = found.unionByName(winners.select("query_id", "address_id", _strategy(), F.round("score", 9).alias("score"), "exact_count"))
    open_queries = queries.join(chosen, "query_id", "left_anti")
    if not open_queries.isEmpty():
        by_token = token_candidates(open_queries, records, text)
        found = found.unionByName(scored(by_token.join(q, "query_id").join(r, "address_id")).select(*cols))
    return top_matches(found, n)


# ------------------------------------------------------------------ decision
def confidence(best: Column, second: Column, strong_fields: Column) -> Column:
    gap = F.when(second.isNotNull(), F.least(F.lit(0.08), F.greatest(F.lit(0.0), best - second))).otherwise(0.0)
    bonus = F.when(strong_fields >= 3, 0.04).when(strong_fields == 2, 0.02).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), best + gap + bonus))


def decide(queries: DataFrame, matches: DataFrame, records: DataFrame) -> DataFrame:
    """One decision per query: accepted address, confidence, review reasons."""
    per = matches.groupBy("query_id").agg(
        F.max(F.when(F.col("place") == 1, F.struct("address_id", "score", "strategy"))).alias("b"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"),
        F.count("*").alias("n_matches"),
    )
    shown = records.select(F.col("address_id").alias("_id"), F.col("canonical_address").alias("_text"))
    j = queries.join(per, "query_id", "left").join(shown, F.col("b.address_id") == F.col("_id"), "left")
    present = lambda fs: sum((F.col(f).isNotNull().cast("int") for f in fs), F.lit(0))
    j = j.withColumns({"_fields": present(FIELDS), "_strong": present(STRONG_FIELDS), "best": F.col("b.score")})
    j = j.withColumn("confidence", F.when(F.col("best").isNotNull(), confidence(F.col("best"), F.col("second"), F.col("_strong"))).otherwise(0.0))
    empty, unmatched = F.col("_fields") == 0, F.col("best").isNull()
    usual = [
        (F.col("best") < 0.72, "Best candidate similarity is below the safe acceptance threshold."),
        (F.col("best") - F.col("second") < 0.05, "The top candidates are too close to distinguish confidently."),
        (F.col("pincode").isNull(), "Pincode is missing; verification cannot use the strongest location key."),
        (F.col("city").isNull(), "City is missing; location-level verification is weaker."),
        (F.col("_fields") < 3, "Only a small number of components are available for verification."),
        (F.col("confidence") < 0.85, "Overall confidence is below the automatic acceptance threshold."),
    ]
    reasons = (
        F.when(empty, F.array(F.lit("At least one address component is required.")))
        .when(unmatched, F.array(F.lit("No candidate address matched the supplied components.")))
        .otherwise(non_null_array([F.when(t, F.lit(m)) for t, m in usual]))
    )
    accepted = F.coalesce(F.col("best") >= 0.60, F.lit(False))
    plain = A.none_if_blank(written())
    strategy = F.when(empty, "no_components").otherwise(F.coalesce("b.strategy", F.lit("no_block")))
    return j.select(
        "query_id",
        F.when(accepted, F.col("_text")).otherwise(plain).alias("normalized_address"),
        F.when(accepted, F.col("b.address_id")).alias("candidate_address_id"),
        F.round("confidence", 3).alias("confidence"),
        F.concat(F.lit("structured:"), strategy).alias("matching_strategy"),
        reasons.alias("review_reasons"),
        (F.size(reasons) > 0).alias("requires_human_review"),
        F.coalesce("n_matches", F.lit(0).cast("bigint")).alias("n_matches"),
    )


def resolve(queries: DataFrame, records: DataFrame, raw: str = "raw_address") -> DataFrame:
    """Free text to stored addresses for a whole table of queries.

    Equal texts are resolved once and joined back. A null text has no components.
    """
    texts = queries.groupBy(raw).agg(F.min("query_id").alias("lead"))
    parsed = clean_columns(parse_raw(texts.withColumnRenamed("lead", "query_id"), raw))
    parsed = materialize(parsed, "address-queries")
    stored = materialize(clean_columns(parse_canonical(records)), "address-records")
    decisions = decide(parsed, best_matches(parsed, stored), stored)
    texts = texts.withColumnRenamed(raw, "_raw")
    lead = queries.join(texts, queries[raw].eqNullSafe(texts["_raw"])).select("query_id", "lead")
    return lead.join(decisions.withColumnRenamed("query_id", "lead"), "lead").drop("lead")
