"""Manifest, fill-in-the-middle and personal data against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.llm import doc_bitmaps, merkle
from verdigris.llm.fill_in_middle import fill_in_middle, fill_in_middle_digests, restored
from verdigris.llm.merkle import document_manifest, folded, manifest
from verdigris.llm.personal_data import BASE, KINDS, PATTERNS, account_check, luhn, personal_data, span_report, spans_of
from verdigris.llm.rank_index import ERROR, RankIndex


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def stored(spark, tmp_path_factory, rows, schema, parts=3):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at int, `group` string, n int, path string, h0 int, spans int, id string"
EXTRA = (1, "g", 2, "p", 3, 4, "i")


# -- manifest ------------------------------------------------------------------------------


def leaf_of(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def ascii_lower(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_manifest(rows):
    def reduce(nodes):
        """Levels of one tree."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
        return levels

    def walk(levels, at, mine, proof):
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            left, right = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
            proof += left + right
            mine, at = sha(left + mine + right), at // 16
        return mine, proof

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda t: t[:3])
        trees[s] = reduce([t[2] for t in groups[s]])
    high = reduce([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(groups[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            shown = leaf_of(r, ascii_lower(r[4])) if tampered else leaf
            mine, proof = walk(trees[s], at, shown, "")
            mine, proof = walk(high, place, mine, proof)
            out.append((r[0], leaf, trees[s][-1][0], high[-1][0], sha(proof), mine, mine == high[-1][0]))
    return sorted(out, key=str)


def manifest_rows():
    rng = random.Random(3)
    rows = []
    for k in range(700):
        source = ["big", "big", "big", "mid", None, "é"][k % 6] if k > 20 else f"lone{k}"
        rows.append((k * 977 - 90_000, source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Text A", "low", None, "", "ÄÖ Z"]) and f"Doc {k} É"))
    rows += [(None, "big", "en", 1, "no id"), (None, "big", "en", 1, "no id"), (None, None, None, None, None), (None, "only", None, None, "")]
    rows += [rows[100]] * 3 + [(rows[100][0], rows[100][1], "xx", 9, f"other text {k}") for k in range(20)]
    rows += [(2**40 + k, "far", "en", 0, "FAR") for k in range(3)] + [(-(2**40), "far", "en", 0, "")]
    return rows


def test_manifest(spark, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(merkle, "CROWD", 4)  # nearly every bucket is cut into slices
    rows = manifest_rows()
    docs = stored(spark, tmp_path_factory, [r + EXTRA for r in rows], SCHEMA)
    got = [tuple(r) for r in document_manifest(docs).collect()]
    assert sorted(got, key=str) == brute_manifest(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_small(spark, tmp_path_factory):
    none = stored(spark, tmp_path_factory, [], SCHEMA, 1)
    assert document_manifest(none).collect() == []
    one = [(7, "s", "en", 3, "abc")]
    docs = stored(spark, tmp_path_factory, [r + EXTRA for r in one], SCHEMA, 1)
    got = document_manifest(docs).collect()
    assert [tuple(r) for r in got] == brute_manifest(one)
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == sha("")


def test_manifest_path(spark, tmp_path_factory):
    """One full tree of two levels and one more leaf, without any crowded bucket."""
    rows = [(k, "s" if k < 257 else "t", "en", 3, f"t{k}") for k in range(260)]
    docs = stored(spark, tmp_path_factory, [r + EXTRA for r in rows], SCHEMA)
    made = manifest(docs, merkle.digest_of(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))), F.col("source"), F.col("doc_id"), {"kept": F.col("text")})
    done = made.select("id", "kept", "leaf", "subroot", "root", (folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("same")).collect()
    assert all(r.same and r.kept == f"t{r.id}" for r in done)
    assert sorted((r.id, r.leaf, r.subroot, r.root) for r in done) == sorted(b[:4] for b in brute_manifest(rows))


def test_bitmaps():
    rng = np.random.default_rng(1)
    for size in (1, 50, 4095, 4096, 30_000):
        ids = np.sort(rng.choice(doc_bitmaps.WIDTH, size, replace=False))
        times = rng.choice([1, 1, 1, 3], size)
        rows = np.repeat(ids, times)
        rng.shuffle(rows)
        batches = [pa.RecordBatch.from_arrays([pa.array(["g"] * len(p)), pa.array(p + (5 << 16))], ["group", "id"]) for p in np.array_split(rows, 4) if len(p)]
        parts = [p for b in batches for p in doc_bitmaps.build(iter([b]))]
        (merged,) = doc_bitmaps.merge(iter(parts))
        assert merged.num_rows == 1 and merged.column(1)[0].as_py() == 5 and merged.column(5)[0].as_py() == len(rows)
        assert np.array_equal(doc_bitmaps.unpack(merged.column(2)[0].as_py()), ids)
        ranks = doc_bitmaps.Ranks(*(merged.column(k)[0].as_py() for k in (2, 3, 4)))
        assert np.array_equal(ranks.rank(ids), np.searchsorted(np.sort(rows), ids))
        assert np.array_equal(ranks.repeated(ids), times > 1)


# -- fill-in-the-middle ------------------------------------------------------------------------


def test_rank_index():
    rng = np.random.default_rng(2)
    lists = [[0], [0, 1], [0, 10**9], list(range(5000)), np.cumsum(rng.integers(1, 40, 20_000)).tolist()]
    lists.append(np.cumsum(np.where(rng.random(3000) < 0.01, 10**6, 1)).tolist())  # long jumps
    lists.append((np.arange(3000) ** 2).tolist())
    first = np.cumsum([0, *map(len, lists)])
    index = RankIndex(np.concatenate(lists), first)
    for k, values in enumerate(lists):
        assert np.array_equal(index(np.full(len(values), k), np.arange(len(values))), values)
    assert np.abs(index.residual.astype(int)).max() <= ERROR and len(index.start) < first[-1] // 10


def middle_texts():
    rng = random.Random(8)
    words = ["a", "Wörter", "東京", "😀x", "<P", "S>", "<", "don't", "1.5"]
    gaps = [" ", "  ", "\n", "\t\x0b", "\x0c\r"]
    out = [None, "", " ", "\n\n", "one", " one", "one ", " one\t", "has <P> mark", "has <S> mark", "x<M>", "a\u00a0b c"]
    for _ in range(150):
        n = rng.randint(1, 60)
        out.append(rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n)) + rng.choice(["", "end"]))
    out.append("".join(rng.choice(words) * rng.randint(1, 30) + rng.choice(gaps) for _ in range(40_000)))
    out += ["y" * 3_000_000, " " * 100_000]
    return out


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    key = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, tmp_path_factory):
    texts = middle_texts()
    rows = [(k, "s", "en", 1, t) for k, t in enumerate(texts * 2)] + [(None, "s", "en", 1, texts[20]), (5, None, None, None, texts[20]), (5, None, None, None, texts[20])]
    docs = stored(spark, tmp_path_factory, [r + EXTRA for r in rows], SCHEMA)
    made = fill_in_middle(docs).collect()
    want = [brute_middle(r[0], r[4]) for r in rows]
    assert sorted(map(tuple, made), key=str) == sorted(want, key=str)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    digests = fill_in_middle_digests(docs).collect()
    assert sorted((r.doc_id or -1, r.output_sha256, r.restored_sha256) for r in digests) == sorted(
        (w[0] or -1, sha(w[5]), sha(r[4] or "")) for w, r in zip(want, rows)
    )


def test_fill_in_middle_small(spark, tmp_path_factory):
    none = stored(spark, tmp_path_factory, [], SCHEMA, 1)
    assert fill_in_middle_digests(none).collect() == []
    docs = stored(spark, tmp_path_factory, [(k, "s", "en", 1, "a b <S") + EXTRA for k in range(200)], SCHEMA)
    every = fill_in_middle(docs, rate=100, suffix_first=0)
    assert {r.form for r in every.collect()} == {"psm"}
    assert {r[0] for r in every.select(restored(F.col("output"), F.col("form"))).collect()} == {"a b <S"}


# -- personal data -------------------------------------------------------------------------------

FULL = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}


def brute_spans(text):
    out = []
    for nth, kind in enumerate(KINDS):
        for m in FULL[kind].finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "login": True,
                "ip": kind != "ip" or all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
                "account": kind != "account" or account_check(m[0]),
            }[kind]
            if good:
                out.append((m.start(), nth, m.end()))
    return sorted(out)


PLANTED = [
    "mail a.b+c@mail5.example.com, then x@y then z@q.r.s.", "a@b.c@d.e f@g.h-i.j..k", "@@ @a.b a@.b a@b. é@x.y",
    "ip 1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8 1.2.3", "9" * 30 + ".1.1.1 0000000001.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "4111111111111111 4111111111111111", "79927398713 799273987130",
    "+1 (743) 555-3824 éeux +49-30-1234567- +1 +12 +1 2", "+1 (2" + " " * 50 + "x", "++1 234 567 890+1 234 567 890",
    "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432.", "XDE89370400440532013000 DE89370400440532013001 DE893704004405320130001",
    "https://user:pass@host.example/x ftp://u:p@h 1ab+c://:x@ a://b://u:p@ http://host:80/x@", "://u:p@h .://u:p@h",
]


def test_spans():
    for text in PLANTED:
        assert spans_of(text) == brute_spans(text), text
    rng = random.Random(4)
    for alphabet in ("0123 .-+()", "ab.@-_ +é", "a:/@ .1+", "0.1 2", "DE89370400 532", "40 -1", "a1@.:/+- "):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert spans_of(text) == brute_spans(text), text
    kinds = {KINDS[k] for t in PLANTED for _, k, _ in spans_of(t)}
    assert kinds == set(KINDS)


def test_personal_data(spark, tmp_path_factory):
    long = "w " * 1_000_000 + "tail@example.com " + "7" * 200_000 + " 10.0.0.1"
    texts = [None, "", "plain words only", *PLANTED, "東京😀 x@y.z 😀 1.2.3.4", long]
    rows = [(k, "s", "en", 1, t) for k, t in enumerate(texts)] + [(None, "s", "en", 1, PLANTED[0]), (3, "s", "en", 1, PLANTED[0])] * 2
    docs = stored(spark, tmp_path_factory, [r + EXTRA for r in rows], SCHEMA)
    want = []
    for r in rows:
        found = [(KINDS[k], s, e) for s, k, e in brute_spans(r[4] or "")]
        listed = [",".join(f"{k}:{s}:{e}" for k, s, e in found if k in kinds) for kinds in (BASE, KINDS)]
        want.append((r[0], *[sum(k == b for k, _, _ in found) for b in BASE], sha(listed[0]), listed[1]))
    assert sorted(map(tuple, span_report(docs).collect()), key=str) == sorted(want, key=str)
    none = stored(spark, tmp_path_factory, [], SCHEMA, 1)
    assert span_report(none).collect() == [] and personal_data(none).collect() == []
