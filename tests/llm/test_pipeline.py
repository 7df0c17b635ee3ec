"""Every stage of the pipeline on a small corpus, each against brute force on what the one before kept."""

import random

import pytest
from test_operators import library, linked_components, removal, words_of

import corpus_pipeline
from verdigris.llm import toxicity
from verdigris.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(600)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, base = say(40), say(90)
    texts = [" ".join(say(rng.randint(1, 150))) for _ in range(90)]
    texts += [" ".join([*say(30), *passage, *say(20)]) for _ in range(8)]
    for k in range(20):
        near = list(base)
        for _ in range(k % 5):
            near[rng.randrange(90)] = rng.choice(vocab)
        texts.append(" ".join(near))
    texts += [texts[3]] * 5 + [None, "", "  ", " ".join(say(3000))]
    bad = ["vile", "scum", "wretch"]
    toxic = {k for k in range(90) if k % 6 == 0}
    texts = [f"{t} {' '.join(rng.choice(bad) for _ in range(8))}" if k in toxic else t for k, t in enumerate(texts)]
    rows = [(k, t, "en", ["a", "a", "b", None][k % 4], len(t) if t is not None else None) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(90)], "doc_id long, quality long, toxic long").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What every stage got and gave, each result stored as Parquet before the next, as the check does."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, folder).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == COLUMNS and stages[name][1].count() > 0
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages[name][1].collect())


def test_toxic_documents_go(spark, folder, stages):
    before, after = stages["toxicity"]
    scores = toxicity.toxicity_scores(before, toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    clean = {r.doc_id for r in scores if r.predicted == 0}
    assert {r.doc_id for r in after.collect()} == clean and 0 < len(clean) < len(scores)
    assert set(texts(after)) <= set(texts(before))


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = linked_components([(i, t, None) for i, t in texts(before)], 5, 80)
    want = {i for i, n, c in groups if n == 0 or i == c}
    assert {i for i, _ in texts(after)} == want and len(want) < len(groups)


def test_repeated_passages_go(stages):
    before, after = stages["substring_dedup"]
    want = {i: n - gone for i, n, gone, _ in removal(texts(before))}
    assert {i: len(words_of(t)) for i, t in texts(after)} == want
    assert sum(want.values()) < sum(len(words_of(t)) for _, t in texts(before))


def test_mix_takes_near_its_targets(stages):
    before, after = stages["mixing"]
    size, source = ({r.doc_id: v for r in before.collect() for v in [f(r)]} for f in (lambda r: len(words_of(r.text)), lambda r: r.source))
    taken = {}
    for r in after.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words_of(r.text))
        assert words_of(r.text) == words_of(dict(texts(before))[r.doc_id])[: len(words_of(r.text))]
    assert all(n <= 2 * size[i] for i, n in taken.items())
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    own = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(own.values())
    rest = list(names)
    while True:
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if weight[s] * level > 2 * own[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * own[s]
            left -= target[s]
            rest.remove(s)
    target |= {s: weight[s] * level for s in rest}
    for s in names:
        assert abs(sum(n for i, n in taken.items() if source[i] == s) - target[s]) <= 1


def test_packed_sequences_hold_the_mix(stages):
    before, after = stages["packing"]
    pieces = after.collect()
    lib = library()
    want = sorted(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert sum(p.length for p in pieces) == sum(want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(want) // 2048) + 1 and vocabulary()


def test_run_gives_the_last_stage(spark, folder, stages):
    ours = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert ours == sorted(tuple(r) for r in stages["packing"][1].select("doc_id", "piece", "start", "length", "ids_crc32").collect())
