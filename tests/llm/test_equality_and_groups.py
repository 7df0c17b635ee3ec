"""Equal names of unequal texts, row ids across scans, and large groups of near copies."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from verdigris.llm import substring_dedup
from verdigris.llm.jaccard_join import keyed_components, one_of_each, similar_components
from verdigris.llm.substring_dedup import repeat_report, without_repeats
from verdigris.llm.words import Words, runs


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


ODD_WORDS = [thue_morse(n, *ab) for n in (8, 64, 1024, 2048) for ab in (("a", "b"), ("b", "a"), ("A", "B"), ("B", "A"), ("\x01", "\x02"))]


def stored(spark, folder, texts, parts=3):
    path = str(folder / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def test_word_hashes():
    rng = random.Random(1)
    words = {"".join(rng.choice("abAB\x01é") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(3000)} | set(ODD_WORDS)
    words |= {w + "\x00" for w in list(words)[:200]} | {"x" * n for n in range(1, 60)}
    words = sorted(words)
    text = pa.array([" ".join(words[:1000]), None, " \t" + "  ".join(words[1000:]) + " "])
    hashes = Words(text).hashes()
    assert len(set(hashes.tolist())) == len(words)
    alone = np.concatenate([Words(pa.array([w])).hashes() for w in words])
    assert np.array_equal(hashes, alone)  # a word's hash depends on nothing around it
    swapped = Words(pa.array([" ".join(thue_morse(64, "x ", "y ").split()), " ".join(thue_morse(64, "y ", "x ").split())])).hashes()
    for size in (1, 3, 5, 16, 20, 64):
        for stream in (0, 1):
            ours = runs(swapped, size, stream)
            assert len(ours) == 128 - size + 1
            sequences = [tuple(swapped[k : k + size]) for k in range(len(ours))]
            assert len(set(ours.tolist())) == len(set(sequences))


def test_odd_words_are_different_words(spark, tmp_path):
    texts = [" ".join([w] * 3 + [f"{k} tail"]) for k, w in enumerate(ODD_WORDS)] + [" ".join([w] * 3) for w in ODD_WORDS]
    docs = stored(spark, tmp_path, texts)
    got = {r.doc_id: r.component_id for r in similar_components(docs, 3, 90).collect()}
    lower = {}
    for k, w in enumerate(ODD_WORDS):  # equal but for case
        lower.setdefault(w.lower(), len(ODD_WORDS) + k)
    want = {len(ODD_WORDS) + k: lower[w.lower()] for k, w in enumerate(ODD_WORDS)} | {k: k for k in range(len(ODD_WORDS))}
    assert got == want
    folder = tmp_path / "windows"
    folder.mkdir()
    docs = stored(spark, folder, [" ".join([f"v{k}" for k in range(10)] + [w] + [f"u{k}" for k in range(10)]) for w in ODD_WORDS])
    assert {r.n_removed for r in repeat_report(docs).collect()} == {0}


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def family(seed, copies, words, edits):
    """Copies of one text, each with some words replaced; the more edits the fewer link."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(copies):
        mine = list(base)
        for _ in range(rng.choice(edits)):
            mine[rng.randrange(words)] = f"e{k}_{rng.randrange(10**6)}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("size,percent,cell,bits", [(3, 90, 4, 64), (5, 80, 4, 5)])
def test_cells_and_names_change_nothing(spark, tmp_path, size, percent, cell, bits):
    texts = family(1, 60, 80, [0, 1, 1, 2, 3, 4]) + family(2, 40, 40, [0, 2, 5]) + [None, "", "one", "two words"] * 2
    docs = stored(spark, tmp_path, texts)
    found = keyed_components(docs, size, percent, cell=cell, name_bits=bits).collect()
    assert [r.component_id for r in sorted(found, key=lambda r: r.doc_id)] == brute(texts, size, percent)


def test_large_group(spark, tmp_path):
    """Many near copies, many of them below the threshold to each other but linked through the base."""
    texts = family(3, 1200, 60, [1, 1, 2, 3]) + [" ".join(f"z{k}_{j}" for j in range(30)) for k in range(50)]
    docs = stored(spark, tmp_path, texts, 7)
    found = {r.doc_id: r.component_id for r in similar_components(docs, 5, 80).collect()}
    assert [found[k] for k in range(len(texts))] == brute(texts, 5, 80)
    assert one_of_each(docs).count() == len(set(found.values()))


def test_rows_keep_their_ids_when_cores_come_and_go(spark, tmp_path, monkeypatch):
    texts = family(4, 200, 40, [0, 1, 3]) + [f"only {k} " + " ".join(f"t{k}_{j}" for j in range(25)) for k in range(200)]
    docs = stored(spark, tmp_path, texts, 2)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        kept, cut = [], []
        for cores in ("4", "7"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            found = keyed_components(docs)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "11")  # between the first jobs and the last one
            assert [r.component_id for r in sorted(found.collect(), key=lambda r: r.doc_id)] == brute(texts, 5, 80)
            kept.append({tuple(r) for r in one_of_each(docs).collect()})
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            frame = without_repeats(docs)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
            cut.append({tuple(r) for r in frame.collect()})
        assert kept[0] == kept[1] and cut[0] == cut[1]
        assert {texts[i] for i, _ in kept[0]} == {t for _, t in kept[0]}  # every row is a row of the input
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_window_rows_keep_place_and_check_in_one_number():
    start = np.array([0, 1, 70_000, 2**31 - 1, 5, 5])
    check = np.array([0, -1, -(2**31), 2**31 - 1, 7, -7], np.int32)
    packed = substring_dedup._packed(start, check)
    got = substring_dedup._unpacked(packed)
    assert got[0].tolist() == start.tolist() and got[1].tolist() == check.tolist()
    assert (np.diff(substring_dedup._packed(np.arange(100), np.full(100, -3, np.int32))) > 0).all()  # by place where the checks agree
