"""Registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import toxicity
from verdigris.llm.embedding_dups import near_duplicates
from verdigris.llm.fill_in_middle import fill_in_middle_digests
from verdigris.llm.jaccard_join import similar_components
from verdigris.llm.merkle import LOWER, UPPER, document_manifest
from verdigris.llm.mixing import taken_words
from verdigris.llm.packing import pack
from verdigris.llm.personal_data import BASE, KINDS, PATTERNS, span_report
from verdigris.llm.sharding import KEY, ROUND_PAIRS, STEPS, shard_rows
from verdigris.llm.substring_dedup import repeat_report
from verdigris.llm.token_counts import token_counts
from verdigris.llm.topk import top_k
from verdigris.llm.url_filter import judge_urls
from verdigris.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"
# The rules of the page filter as (verdict, host, path prefix).
PAGE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary())


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, folder, "labels")))


# -- SQL of the checks -----------------------------------------------------------------

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components_sql(edges: str) -> str:
    """Recursive reach over ``edges`` (a, b), given in both directions."""
    return f"reach(a, b) AS (SELECT a, b FROM ({edges}) UNION SELECT r.a, e.b FROM reach r JOIN ({edges}) e ON r.b = e.a)"


def _crc_sql() -> str:
    """CRC-32 of a text's bytes, four bits at a time, low half of a byte first."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    halves = r"string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), '')"
    numbers = f"list_transform(list_filter({halves}, lambda c: c <> ''), lambda c: (strpos('0123456789ABCDEF', c) - 1)::BIGINT)"
    step = f"lambda a, x: xor(a >> 4, ({table}::BIGINT[])[(xor(a, x) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), {step}), 4294967295::BIGINT)"


def _shards_sql() -> str:
    moved = "SELECT number, n, a, b, turn, p // b AS l, p % b AS r FROM {}"
    steps = ""
    for k in range(ROUND_PAIRS):
        key = (KEY * (2 * k + 1) + k * 7919) % 1_000_003
        for side, other, size, extra in (("l", "r", "a", 0), ("r", "l", "b", 1_000_003)):
            mixed = f"({other} + {key + extra})"
            for factor, offset, modulus in STEPS:
                mixed = f"(({mixed} * {factor} + {offset}) % {modulus})"
            kept = {"l": f"({side} + {mixed}) % {size} AS l, r", "r": f"l, ({side} + {mixed}) % {size} AS r"}[side]
            steps = f"SELECT number, n, a, b, turn, {kept} FROM ({steps or moved})"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {_crc_sql()} AS text_crc32 FROM documents),
  o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number, count(*) OVER () AS n FROM d),
  s AS (SELECT number, n, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM o),
  start AS (SELECT number, n, a, (n + a - 1) // a AS b, 0 AS turn, number AS p FROM s),
  walk AS (SELECT * FROM start UNION ALL
    SELECT number, n, a, b, turn + 1, l * b + r FROM ({steps.format("(SELECT * FROM walk WHERE turn = 0 OR p >= n)")})),
  done AS (SELECT number, arg_max(p, turn) AS p FROM walk GROUP BY number)
  SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 8)::INT AS shard, p // 8 AS slot, NULL::INT AS grown_shard FROM o JOIN done USING (number)"""


_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
  {_components_sql("SELECT a, b FROM e")}
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) m ON m.a = d.doc_id"""

_MIXING_SQL = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
  c AS (SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][(nth - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
  t AS (SELECT *, sum(w) OVER () AS all_w, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
        sum(w) OVER o AS w_upto, sum(cap) OVER o AS cap_upto FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT *, (budget - cap_upto + cap) / (all_w - w_upto + w) AS here FROM t),
  l AS (SELECT arg_min(here, w_upto) AS level FROM h WHERE cap > here * w),
  g AS (SELECT source, source_size, CASE WHEN cap <= here * w THEN cap ELSE level * w END AS target FROM h, l),
  p AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS want,
        sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
  SELECT doc_id, size, source_size, target,
    (greatest(0, least(upto, want) - (upto - size)) + greatest(0, least(upto + source_size, want) - (upto - size + source_size)))::BIGINT AS taken FROM p"""

_REPEATS_SQL = f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
  v AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
  r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM v) WHERE nth > 1),
  gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r),
  word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
  FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)"""

_VECTORS_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
  {_components_sql("SELECT a, b FROM e")}
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept
  FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) n ON n.a = vec_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) m ON m.a = vec_id"""

_URL_SQL = f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
  m AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
        FROM h JOIN r ON (h.host = r.host OR suffix(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY 1)
  SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)"""


@query("op3_shards", _shards_sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents"))


@query("op4_jaccard_join", _JACCARD_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(table(spark, folder, "documents"), size=3, percent=90).drop("rid")


@query("op5_mixing", _MIXING_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(table(spark, folder, "documents"))


@query("op8_url_filter", _URL_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), PAGE_RULES)


@query("op7_embedding_dups", _VECTORS_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary())


@query(
    "op10_topk",
    """WITH v AS (
         SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
       p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
             FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
       SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


@query("op6_substring_dedup", _REPEATS_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_report(table(spark, folder, "documents"))


def _manifest_sql() -> str:
    def leaf(text: str) -> str:
        parts = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p}::VARCHAR))::VARCHAR || ':' || {p}::VARCHAR, '-')" for p in parts) + ")"

    def tree(name: str, nodes: str) -> str:
        """Nodes of all levels of trees keyed ``g``: (lvl, g, c, n, h)."""
        return f"""{name} AS (SELECT 0 AS lvl, g, c, n, h FROM ({nodes}) UNION ALL
    SELECT lvl + 1, g, c // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY c)) FROM {name} WHERE n > 1 GROUP BY lvl, g, c // 16),
  {name}_side AS (SELECT x.lvl, x.g, x.c, coalesce(string_agg(y.h, '' ORDER BY y.c) FILTER (y.c < x.c), '') AS l,
      coalesce(string_agg(y.h, '' ORDER BY y.c) FILTER (y.c > x.c), '') AS r
    FROM {name} x JOIN {name} y ON x.lvl = y.lvl AND x.g = y.g AND x.c // 16 = y.c // 16 WHERE x.n > 1 GROUP BY x.lvl, x.g, x.c)"""

    def walk(name: str, of: str, rows: str) -> str:
        return f"""{name} AS (SELECT row, 0 AS lvl, g, c, h, p FROM ({rows}) UNION ALL
    SELECT row, w.lvl + 1, w.g, w.c // 16, sha256(s.l || h || s.r), p || s.l || s.r FROM {name} w JOIN {of}_side s ON w.lvl = s.lvl AND w.g = s.g AND w.c = s.c),
  {name}_end AS (SELECT row, arg_max(g, lvl) AS g, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM {name} GROUP BY row)"""

    crc = _crc_sql().replace("text", "doc_id::VARCHAR")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {leaf("text")} AS leaf,
      CASE WHEN coalesce({crc} % 5 = 0 AND doc_id IS NOT NULL, false) THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS shown FROM documents),
  placed AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS c, count(*) OVER (PARTITION BY g) AS n FROM d),
  {tree("low", "SELECT g, c, n, leaf AS h FROM placed")},
  subroots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS c, count(*) OVER () AS n FROM low WHERE n = 1),
  {tree("high", "SELECT '' AS g, c, n, h FROM subroots")},
  {walk("up", "low", "SELECT row, g, c, shown AS h, '' AS p FROM placed")},
  {walk("top", "high", "SELECT row, '' AS g, s.c, u.h, u.p FROM up_end u JOIN subroots s ON s.g = u.g")}
  SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(t.p) AS proof_sha256, t.h AS folded_root, t.h = r.h AS verified
  FROM placed JOIN subroots s USING (g) JOIN top_end t USING (row), (SELECT h FROM high WHERE n = 1) r"""


@query("op11_merkle_manifest", _manifest_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return document_manifest(table(spark, folder, "documents"))


_MIDDLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
  h AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    list_transform(range(4), lambda i: list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(k, (1 + 8 * i)::INT, 8), ''),
      lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, x: a * 16 + x)) AS h FROM d),
  c AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM p"""


@query("op12_fill_in_middle", _MIDDLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, folder, "documents"))


def _personal_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({digits}, (length({digits}) - i + 1)::INT, 1)::INT
      ELSE (2 * substr({digits}, (length({digits}) - i + 1)::INT, 1)::INT) // 10 + (2 * substr({digits}, (length({digits}) - i + 1)::INT, 1)::INT) % 10 END)) % 10 = 0"""
    plain = "replace(m, ' ', '')"
    value = "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END"
    numbers = f"array_to_string(list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), {value}), '')"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "account": f"list_reduce(list_prepend(0, list_transform(string_split({numbers}, ''), lambda c: c::INT)), lambda a, x: (a * 10 + x) % 97) = 1",
        "login": "true",
    }
    finds = []
    for nth, kind in enumerate(KINDS):
        pattern = PATTERNS[kind].replace("'", "''")
        finds.append(f"""SELECT row, {nth} AS nth, '{kind}' AS kind, m, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT row, ms, p, i, ms[i] AS m FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS p FROM d), unnest(range(1, len(ms) + 1)) AS t(i)) WHERE {valid[kind]}""")
    base = f"kind IN {BASE}"
    listed = "coalesce(string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, nth) {}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
  f AS ({" UNION ALL ".join(finds)}),
  g AS (SELECT row, {counts}, {listed.format(f"FILTER ({base})")} AS base, {listed.format("")} AS spans FROM f GROUP BY row)
  SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"""


@query("op13_personal_data", _personal_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return span_report(table(spark, folder, "documents"))
