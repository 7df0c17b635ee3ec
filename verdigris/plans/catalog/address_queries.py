"""Address resolution queries."""

from pyspark.sql import functions as F

from verdigris.functions import address_text as A
from verdigris.operators import address as R
from verdigris.plans.catalog.base_queries import rounded
from verdigris.plans.catalog.prelude import PRELUDE
from verdigris.plans.catalog.registry import query
from verdigris.session import materialize


# ------------------------------------------------------------------ SQL side
def q_basic(x):
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def q_expand(x):
    x = rf"regexp_replace({x}, '\bh\s*no\b', 'house number', 'g')"
    for word, to in A.ABBREVIATIONS.items():
        x = rf"regexp_replace({x}, '\b{word}\b', '{to}', 'g')"
    return q_basic(x)


def q_detect(x, table):
    names = sorted(table.items(), key=lambda kv: -len(kv[0]))
    return "CASE " + " ".join(rf"WHEN regexp_matches({x}, '\b{n}\b') THEN '{c}'" for n, c in names) + " END"


def q_alias(x, table):
    return f"CASE {x} " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in table.items()) + f" ELSE {x} END"


def q_nn(x):
    return f"nullif({x}, '')"


_HOUSE = r"coalesce(nullif(regexp_extract(t, '\b(?:house number|house no|hno|house|flat|apartment|plot)\s*([a-z]?\d+[a-z]?)\b', 1), ''), nullif(regexp_extract(t, '^\s*([a-z]?\d+[a-z]?)\b', 1), ''))"
_PIN = r"nullif(regexp_extract(t, '\b(\d{6})\b', 1), '')"
_COUNTRY = r"CASE WHEN regexp_matches(t, '\b(?:india|bharat)\b') THEN 'india' END"
_MARK = "list_min(list_filter([" + ", ".join(f"list_position(w, '{m}')" for m in A.STREET_WORDS) + "], lambda x: x > 0))"
_CUT = r"CASE WHEN mi IS NULL THEN NULL WHEN regexp_full_match(w[greatest(1, mi - 2)], '[a-z]?\d+[a-z]?') THEN array_to_string(w[greatest(1, mi - 2) + 1 : mi], ' ') ELSE array_to_string(w[greatest(1, mi - 2) : mi], ' ') END"
_AREA = "CASE WHEN len(aw) = 0 THEN NULL " + " ".join(
    f"WHEN list_contains(aw, '{m}') THEN array_to_string(aw[list_position(aw, '{m}') : list_position(aw, '{m}') + 1], ' ')" for m in A.AREA_WORDS
) + " WHEN len(aw) >= 2 THEN array_to_string(aw[-2:], ' ') ELSE aw[1] END"


def q_strip(x, cols):
    for c in cols:
        x = f"replace({x}, coalesce(nullif({c}, ''), '#'), ' ')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def q_parse(source, text, city, pin, removed):
    return f"""
SELECT *, nullif(substr({q_strip('r', ['street', 'area', 'house_no'])}, 1, 120), '') AS b0 FROM (
 SELECT *, {_AREA} AS area FROM (
  SELECT *, list_filter(string_split({q_strip('r', ['street'])}, ' '), lambda x: x <> '') AS aw FROM (
   SELECT *, {q_strip('t', removed)} AS r FROM (
    SELECT *, nullif(regexp_replace({_CUT}, '^((near|opposite)( |$))+', ''), '') AS street FROM (
     SELECT *, {_HOUSE} AS house_no, {city} AS p_city, {q_detect('t', A.STATE_ALIASES)} AS p_state, {_COUNTRY} AS country, {pin} AS p_pin, string_split(t, ' ') AS w, {_MARK} AS mi FROM (
      SELECT *, string_split(t, ' ') AS w FROM (SELECT *, {q_expand(q_basic(text))} AS t FROM {source})))))))"""


PRELUDE["a_rec0"] = q_parse(
    "(SELECT address_id, canonical_address, city AS own_city, pincode AS own_pin FROM fx_addresses)", "canonical_address",
    f"coalesce(nullif({q_alias(q_basic('own_city'), A.CITY_ALIASES)}, ''), {q_detect('t', A.CITY_ALIASES)})",
    rf"coalesce(nullif(regexp_extract(own_pin, '\b(\d{{6}})\b', 1), ''), {_PIN})", ["p_pin", "p_city", "p_state", "'india'", "house_no"],
)
PRELUDE["a_rec"] = rf"""
SELECT address_id, canonical_address, house_no, coalesce(b0, list_filter(list_filter(list_transform(regexp_split_to_array(canonical_address, '[,;|]+'), lambda s: {q_basic('s')}), lambda s: s <> ''),
   lambda s: s <> coalesce(p_city, '') AND s <> coalesce(p_state, '') AND s <> coalesce(p_pin, '') AND NOT regexp_full_match(s, '(?:house|flat|hno)\s*\w+'))[1]) AS building,
  street, area, NULL::VARCHAR AS landmark, p_city AS city, NULL::VARCHAR AS district, p_state AS state, country, p_pin AS pincode FROM a_rec0"""
PRELUDE["a_qry0"] = q_parse("fx_address_queries", "raw_address", q_detect("t", A.CITY_ALIASES), _PIN, ["p_pin", "p_city", "p_state", "country", "street", "house_no"])
PRELUDE["a_qry"] = "SELECT query_id, raw_address, house_no, b0 AS building, street, area, NULL::VARCHAR AS landmark, p_city AS city, NULL::VARCHAR AS district, p_state AS state, country, p_pin AS pincode FROM a_qry0"
_COMPONENTS = "house_no, building, street, area, landmark, city, district, state, country, pincode"


def q_tokens(x):
    stops = ", ".join(f"'{s}'" for s in A.STOP_WORDS)
    return f"list_distinct(list_filter(string_split({q_expand(q_basic(x))}, ' '), lambda z: len(z) > 1 AND z NOT IN ({stops})))"


def q_grams(x):
    flat = f"replace({q_basic(x)}, ' ', '')"
    return f"list_distinct(list_transform(range(1, greatest(len({flat}) - 1, 1)), lambda i: substr({flat}, i, 3)))"


def q_jac(a, b):
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE ELSE 0 END"


_SIDE = ", ".join(
    [f"{q_tokens(f)} AS {f}_tok" for f in R.TOKEN_FIELDS + R.GRAM_FIELDS] + [f"{q_grams(f)} AS {f}_tri" for f in R.GRAM_FIELDS]
)
PRELUDE["a_rec_s"] = f"SELECT *, {_SIDE} FROM a_rec"
PRELUDE["a_qry_s"] = f"SELECT *, {_SIDE} FROM a_qry"
PRELUDE["a_block"] = """
SELECT q.query_id, r.address_id, s.strategy FROM (
  SELECT query_id, CASE WHEN l1 THEN 'pincode+city' WHEN l2 THEN 'pincode' WHEN l3 THEN 'city+state' WHEN l4 THEN 'city' END AS strategy FROM (
    SELECT query_id, EXISTS (SELECT 1 FROM a_rec r WHERE r.pincode = q.pincode AND r.city = q.city) AS l1, EXISTS (SELECT 1 FROM a_rec r WHERE r.pincode = q.pincode) AS l2,
      EXISTS (SELECT 1 FROM a_rec r WHERE r.city = q.city AND r.state = q.state) AS l3, EXISTS (SELECT 1 FROM a_rec r WHERE r.city = q.city) AS l4 FROM a_qry q)) s
JOIN a_qry q USING (query_id) JOIN a_rec r ON CASE s.strategy WHEN 'pincode+city' THEN r.pincode = q.pincode AND r.city = q.city WHEN 'pincode' THEN r.pincode = q.pincode
  WHEN 'city+state' THEN r.city = q.city AND r.state = q.state ELSE r.city = q.city END"""


def q_sim(f):
    left, right = f"q.{f}", f"r.{f}"
    if f == "pincode":
        s = "0"
    elif f in R.TOKEN_FIELDS:
        s = q_jac(f"q.{f}_tok", f"r.{f}_tok")
    else:
        gram = f"CASE WHEN replace({left}, ' ', '') = replace({right}, ' ', '') THEN 1 ELSE {q_jac(f'q.{f}_tri', f'r.{f}_tri')} END"
        s = f"least(1.0::DOUBLE, 0.55::DOUBLE * ({q_jac(f'q.{f}_tok', f'r.{f}_tok')}) + 0.30::DOUBLE * ({gram}) + 0.15::DOUBLE * CAST(contains({left}, {right}) OR contains({right}, {left}) AS DOUBLE))"
    return f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN NULL WHEN {left} = {right} THEN 1.0::DOUBLE ELSE {s} END AS s_{f}"


PRELUDE["a_sims"] = f"""
SELECT b.*, {', '.join(q_sim(f) for f in R.FIELDS)} FROM a_block b JOIN a_qry_s q USING (query_id) JOIN a_rec_s r USING (address_id)"""
_EXACT = " + ".join(f"CAST(coalesce(s_{f} >= 0.999, false) AS INTEGER)" for f in R.FIELDS)
_STRONG = " + ".join(f"CAST(coalesce(s_{f} >= 0.999, false) AS INTEGER)" for f in R.STRONG_FIELDS)
_GOT = " + ".join(f"coalesce(s_{f} * {w}::DOUBLE, 0)" for f, w in R.FIELD_WEIGHTS.items())
_WEIGHT = " + ".join(f"CASE WHEN s_{f} IS NULL THEN 0 ELSE {w}::DOUBLE END" for f, w in R.FIELD_WEIGHTS.items())
PRELUDE["a_scored"] = f"""
SELECT *, round(CASE WHEN {_STRONG} >= 2 THEN least(1.0::DOUBLE, base + 0.04::DOUBLE) ELSE base END, 9) AS score, {_EXACT} AS exact_count FROM (
  SELECT *, CASE WHEN {_WEIGHT} > 0 THEN ({_GOT}) / ({_WEIGHT}) ELSE 0 END AS base FROM a_sims)"""
PRELUDE["a_top"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, exact_count DESC, address_id) AS place FROM a_scored) WHERE place <= 3"
_NF = " + ".join(f"CAST({f} IS NOT NULL AS INTEGER)" for f in R.FIELDS)
_NS = " + ".join(f"CAST({f} IS NOT NULL AS INTEGER)" for f in R.STRONG_FIELDS)
PRELUDE["a_decided"] = f"""
SELECT query_id, CASE WHEN best >= 0.6 THEN addr END AS candidate_address_id, CASE WHEN best >= 0.6 THEN canon ELSE plain END AS normalized_address, round(conf, 3) AS confidence, 'structured:' || strategy AS matching_strategy, n_matches,
  concat_ws('; ', CASE WHEN best < 0.72 THEN 'Best candidate similarity is below the safe acceptance threshold.' END, CASE WHEN best - second < 0.05 THEN 'The top candidates are too close to distinguish confidently.' END,
    CASE WHEN pincode IS NULL THEN 'Pincode is missing; verification cannot use the strongest location key.' END, CASE WHEN city IS NULL THEN 'City is missing; location-level verification is weaker.' END,
    CASE WHEN nf < 3 THEN 'Only a small number of components are available for verification.' END, CASE WHEN conf < 0.85 THEN 'Overall confidence is below the automatic acceptance threshold.' END) AS review_reasons
FROM (SELECT *, greatest(0, least(1, best + CASE WHEN second IS NOT NULL THEN least(0.08::DOUBLE, greatest(0, best - second)) ELSE 0 END + CASE WHEN ns >= 3 THEN 0.04::DOUBLE WHEN ns = 2 THEN 0.02::DOUBLE ELSE 0 END)) AS conf FROM (
  SELECT q.query_id, q.pincode, q.city, max(m.address_id) FILTER (place = 1) AS addr, max(m.score) FILTER (place = 1) AS best, max(m.score) FILTER (place = 2) AS second, max(strategy) AS strategy, count(*) AS n_matches,
    any_value({_NF.replace('CAST(', 'CAST(q.')}) AS nf, any_value({_NS.replace('CAST(', 'CAST(q.')}) AS ns, any_value(concat_ws(', ', {', '.join('q.' + c for c in R.WRITTEN_ORDER)})) AS plain
  FROM a_qry q JOIN a_top m USING (query_id) GROUP BY 1, 2, 3) LEFT JOIN (SELECT address_id AS aid, canonical_address AS canon FROM a_rec) ON aid = addr)"""


# ------------------------------------------------------------------ Spark side
def queries(d):
    if not hasattr(d, "_aq"):
        d._aq = materialize(R.clean_columns(R.parse_raw(d.address_queries, "raw_address")), "aq")
    return d._aq


def records(d):
    if not hasattr(d, "_ar"):
        d._ar = materialize(R.clean_columns(R.parse_canonical(d.addresses)), "ar")
    return d._ar


def pairs(d):
    return R.block_pairs(queries(d), records(d))


@query("a1_basic_text", f"SELECT query_id, {q_basic('raw_address')} AS text FROM fx_address_queries")
def a1(d):
    return d.address_queries.select("query_id", A.basic(F.col("raw_address")).alias("text"))


@query("a2_abbreviations", f"SELECT query_id, {q_expand(q_basic(chr(39) + 'Apt 4 H.No. 12 nr Bombay opp ' + chr(39) + ' || raw_address'))} AS text FROM fx_address_queries")
def a2(d):
    t = F.concat(F.lit("Apt 4 H.No. 12 nr Bombay opp "), F.col("raw_address"))
    return d.address_queries.select("query_id", A.expand(A.basic(t)).alias("text"))


def _q_short():
    x = r"trim(regexp_replace(regexp_replace(lower(raw_address), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
    for p, to in A.SHORT_REPLACEMENTS:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


@query("a3_short_form", f"SELECT query_id, {_q_short()} AS text FROM fx_address_queries")
def a3(d):
    return d.address_queries.select("query_id", A.short_form(F.col("raw_address")).alias("text"))


@query("a4_place_detection", "SELECT query_id, p_city AS city, p_state AS state FROM a_qry0")
def a4(d):
    t = A.basic(F.col("raw_address"))
    return d.address_queries.select("query_id", A.detect(t, A.CITY_ALIASES).alias("city"), A.detect(t, A.STATE_ALIASES).alias("state"))


@query("a4b_alias_lookup", f"SELECT address_id, {q_alias(q_basic('c'), A.CITY_ALIASES)} AS city FROM (SELECT address_id, CASE city WHEN 'Bengaluru' THEN 'Bangalore' WHEN 'Mumbai' THEN ' BOMBAY' ELSE city || ' City' END AS c FROM fx_addresses)")
def a4b(d):
    c = F.when(F.col("city") == "Bengaluru", "Bangalore").when(F.col("city") == "Mumbai", " BOMBAY").otherwise(F.concat("city", F.lit(" City")))
    return d.addresses.select("address_id", A.alias(c, A.CITY_ALIASES).alias("city"))


@query("a5_pincodes", "SELECT query_id, p_pin AS found, CAST(CASE WHEN query_id % 2 = 0 THEN CAST(560000 + query_id % 200 AS VARCHAR) END AS VARCHAR) AS cleaned FROM a_qry0")
def a5(d):
    num = F.when(F.col("query_id") % 2 == 0, (560000 + F.col("query_id") % 200).cast("double").cast("string")).otherwise("n/a")
    return d.address_queries.select("query_id", A.pincode(A.basic(F.col("raw_address"))).alias("found"), A.clean_pincode(num).alias("cleaned"))


@query("a6_house_numbers", "SELECT query_id, house_no, 'b' || CAST(query_id AS VARCHAR) AS named FROM a_qry")
def a6(d):
    named = F.concat(F.lit("shop flat b"), F.col("query_id").cast("string"), F.lit(" x"))
    t = A.expand(A.basic(F.col("raw_address")))
    return d.address_queries.select("query_id", A.house_number(t).alias("house_no"), A.house_number(named).alias("named"))


@query("a7_streets", "SELECT query_id, street FROM a_qry")
def a7(d):
    return queries(d).select("query_id", "street")


@query("a8_areas", "SELECT query_id, area FROM a_qry")
def a8(d):
    return queries(d).select("query_id", "area")


@query("a9_buildings", "SELECT address_id, building FROM a_rec")
def a9(d):
    return records(d).select("address_id", "building")


@query("a10_parsed_records", f"SELECT address_id, {_COMPONENTS} FROM a_rec")
def a10(d):
    return R.parse_canonical(d.addresses).select("address_id", *[c.strip() for c in _COMPONENTS.split(",")])


@query("a10b_parsed_text", f"SELECT query_id, {_COMPONENTS} FROM a_qry")
def a10b(d):
    return R.parse_raw(d.address_queries, "raw_address").drop("raw_address")


@query("a11_component_cleaning", rf"""
SELECT address_id, CAST(1 + address_id % 97 AS VARCHAR) AS house_no, {q_expand(q_basic("p_name || ' Rd'"))} AS street, 'sector ' || CAST(1 + address_id % 60 AS VARCHAR) AS area,
  {q_alias(q_basic('city'), A.CITY_ALIASES)} AS city, {q_basic('state')} AS state, pincode, 'india' AS country FROM fx_addresses""")
def a11(d):
    loose = R.parse_raw(d.addresses.select("address_id", "canonical_address", F.col("city").alias("c"), F.col("pincode").alias("p")), "canonical_address")
    name = F.split("canonical_address", ", ")
    parts = F.create_map(
        F.lit("hno"), F.concat(F.lit("Flat "), F.col("house_no")), F.lit("road"), F.replace(name[1], F.lit("Road"), F.lit("Rd")),
        F.lit("locality"), F.replace(name[2], F.lit("Sector"), F.lit("Sec")), F.lit("city"), F.col("c"), F.lit("state"), F.upper("state"),
        F.lit("zip"), F.concat("p", F.lit(".0")), F.lit("pin"), F.lit(" "), F.lit("country"), F.lit("Bharat"), F.lit("unknown"), F.lit("x"),
    )
    out = R.clean_components(loose.select("address_id", parts.alias("parts")), "parts")
    return out.select("address_id", "house_no", "street", "area", "city", "state", "pincode", "country")


@query("a12_tokens", f"SELECT query_id, array_to_string(list_sort({q_tokens('raw_address')}), ' ') AS tokens FROM fx_address_queries")
def a12(d):
    return d.address_queries.select("query_id", F.array_join(F.array_sort(A.tokens(F.col("raw_address"))), " ").alias("tokens"))


@query("a13_blocking", "SELECT query_id, strategy, count(*) AS candidate_count FROM a_block GROUP BY 1, 2")
def a13(d):
    """Candidates per query, counted from block sizes without forming the pairs."""
    chosen = R.chosen_blocks(queries(d), records(d))
    sizes = R.block_keys(records(d), "address_id").groupBy("level", "key").agg(F.count("*").alias("candidate_count"))
    names = F.array(*[F.lit(s) for s in R.STRATEGIES])
    return chosen.join(sizes, ["level", "key"]).select("query_id", F.element_at(names, F.col("level") + 1).alias("strategy"), "candidate_count")


PRELUDE["a_vague"] = f"SELECT DISTINCT p_name, {q_tokens('p_name')} AS toks FROM part"


@query("a13b_token_fallback", f"""
WITH asked AS MATERIALIZED (SELECT DISTINCT p_name, token FROM (SELECT p_name, unnest(toks) AS token FROM a_vague)),
post AS MATERIALIZED (SELECT DISTINCT address_id, token FROM (SELECT address_id, unnest({q_tokens('canonical_address')}) AS token FROM a_rec) SEMI JOIN asked USING (token)),
freq AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
rarest AS MATERIALIZED (SELECT p_name, token FROM (SELECT p_name, token, row_number() OVER (PARTITION BY p_name ORDER BY coalesce(df, 0), token) AS r FROM asked LEFT JOIN freq USING (token)) WHERE r <= 5),
wanted AS (SELECT p_name, count(*) AS n FROM rarest GROUP BY 1),
h AS MATERIALIZED (SELECT p_name, address_id, count(*) AS hits FROM rarest JOIN post USING (token) GROUP BY 1, 2)
SELECT p_name AS query_id, address_id, CASE WHEN hits = n THEN 'token_intersection' ELSE 'token_union' END AS strategy FROM h JOIN wanted USING (p_name)
WHERE hits = n OR p_name NOT IN (SELECT p_name FROM h JOIN wanted USING (p_name) WHERE hits = n)""")
def a13b(d):
    """Part names as addresses that name no place: only their tokens can find candidates."""
    vague = d.raw("part").select(F.col("p_name").alias("query_id"), "p_name").distinct()
    parsed = R.clean_columns(R.parse_raw(vague, "p_name"))
    return R.token_candidates(parsed, records(d))


_SIMS = [f"s_{f}" for f in R.FIELDS]


@query("a14_field_similarity", f"SELECT query_id, address_id, {', '.join(f'round({s}, 9) AS {s}' for s in _SIMS)} FROM a_sims")
def a14(d):
    return rounded(pairs(d).select("query_id", "address_id", *_SIMS), _SIMS)


@query("a15_weighted_score", "SELECT query_id, address_id, score, exact_count FROM a_scored")
def a15(d):
    return pairs(d).select("query_id", "address_id", "score", "exact_count")


@query("a16_top_matches", "SELECT query_id, address_id, strategy, score, exact_count, CAST(place AS INTEGER) AS place FROM a_top")
def a16(d):
    return R.best_matches(queries(d), records(d)).select("query_id", "address_id", "strategy", "score", "exact_count", "place")


def decided(d):
    return R.decide(queries(d), R.best_matches(queries(d), records(d)), records(d))


@query("a17_confidence", "SELECT query_id, confidence FROM a_decided")
def a17(d):
    return decided(d).select("query_id", "confidence")


@query("a18_decisions", "SELECT query_id, candidate_address_id, review_reasons, review_reasons <> '' AS requires_human_review FROM a_decided")
def a18(d):
    return decided(d).select("query_id", "candidate_address_id", F.array_join("review_reasons", "; ").alias("review_reasons"), "requires_human_review")


@query("a19_written_form", f"SELECT query_id, concat_ws(', ', {', '.join(R.WRITTEN_ORDER)}) AS written FROM a_qry")
def a19(d):
    return queries(d).select("query_id", R.written().alias("written"))


@query("a20_resolve", "SELECT query_id, candidate_address_id, normalized_address, confidence, matching_strategy, review_reasons, n_matches FROM a_decided")
def a20(d):
    out = R.resolve(d.address_queries, d.addresses)
    return out.withColumn("review_reasons", F.array_join("review_reasons", "; ")).drop("requires_human_review")
