"""Toxicity scores from a counterfactually regularized linear classifier.

Features are words and byte runs inside words that a text holds (lower-cased in A-Z), chosen
by how unevenly the classes hold them. Every training text that names a group is paired with a
copy in which group names are swapped for others of their kind; the loss adds the squared
change of the score between the two, so that a neutral mention of a group does not move it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.arrow import arrow_map, field
from verdigris.llm.words import Words, mix, slices
from verdigris.session import materialize

# Names of groups, by kind; a name is swapped only within its kind.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["blind", "deaf", "disabled", "autistic"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous"],
    ["mujeres", "hombres", "chicas", "chicos"],
    ["musulmanes", "cristianos", "judíos", "hindúes"],
]

MAX_TOXIC, MAX_CLEAN = 4_000, 8_000  # bound on the labelled rows a fit uses
FEATURES = 1_024
RUNS = (4, 6)
SWAP_PENALTY, DECAY, STEPS = 4.0, 1e-5, 1_000


def swapped(text: str) -> str | None:
    """The text with each group name replaced by the next of its kind; None if it names none."""
    kinds = {t: g[(k + 1) % len(g)] for g in IDENTITY_TERMS for k, t in enumerate(g)}
    pattern = re.compile(r"(?<!\w)(" + "|".join(sorted(kinds, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    out, n = pattern.subn(lambda m: kinds.get(m.group(1).lower(), m.group(1)), text)
    return out if n else None


def text_features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature digests and the text that holds each: whole words, then runs of bytes inside words."""
    yield mix(words.hashes()), words.row
    data = words.data
    size = words.ends - words.starts
    for n in RUNS:
        fits = np.flatnonzero(size >= n)
        many = size[fits] - n + 1
        at = np.repeat(words.starts[fits] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(256) + data[at + k]
        yield mix(value), np.repeat(words.row[fits], many)


def _held(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct feature digests of each text."""
    out: list[np.ndarray] = []
    for _, part in slices(pa.array(texts, pa.large_string())):
        words = Words(part, lower=True)
        found = list(text_features(words))
        digest, row = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        by = np.lexsort((digest, row))
        digest, row = digest[by], row[by]
        new = np.ones(len(row), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
        digest, row = digest[new], row[new]
        out += np.split(digest, np.searchsorted(row, np.arange(1, len(part))))
    return out


@dataclass(frozen=True)
class Model:
    """Weights of feature digests (sorted), and the score of a text that holds none."""

    digests: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, arr: pa.Array) -> np.ndarray:
        sums = np.full(len(arr), self.intercept)
        bits = 20
        maybe = np.zeros(1 << bits, bool)
        maybe[(self.digests >> np.uint64(64 - bits)).astype(np.int64)] = True
        for at, part in slices(arr):
            for digest, row in text_features(Words(part, lower=True)):
                near = np.flatnonzero(maybe[(digest >> np.uint64(64 - bits)).astype(np.int64)])
                if not len(near) or not len(self.digests):
                    continue
                k = np.searchsorted(self.digests, digest[near]).clip(max=len(self.digests) - 1)
                hit = self.digests[k] == digest[near]
                pair = np.unique(row[near][hit] * len(self.digests) + k[hit])
                np.add.at(sums, at + pair // len(self.digests), self.weights[pair % len(self.digests)])
        return 1 / (1 + np.exp(-np.clip(sums, -40, 40)))


@dataclass(frozen=True)
class Rows:
    """A sparse matrix: value ``value[k]`` at row ``row[k]``, feature ``col[k]``."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(lists: list[list[int]], features: int, sign: float = 1.0) -> Rows:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        col = np.array([c for x in lists for c in x], np.int64)
        return Rows(row, col, np.full(len(col), sign), (len(lists), features))

    def plus(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("row", "col", "value")), self.shape)

    def scaled(self, by: np.ndarray) -> Rows:
        return Rows(self.row, self.col, self.value * by[self.col], self.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * e[self.row], self.shape[1])


def fit_linear(x: Rows, y: np.ndarray, change: Rows, penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept; ``change`` holds feature differences of swapped pairs."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v, rate = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.05
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -40, 40)))
        error = (p - y) / len(y)
        g = np.append(x.transposed_times(error) + DECAY * w, error.sum())
        if change.shape[0]:
            g[:-1] += penalty * change.transposed_times(change.times(w)) / change.shape[0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def kept_log_odds(toxic: int, clean: int, max_toxic: int, max_clean: int) -> float:
    """What keeping at most so many rows of each class adds to the log-odds of toxic."""
    kept = [min(1.0, most / n) if n else 1.0 for n, most in ((toxic, max_toxic), (clean, max_clean))]
    return float(np.log(kept[0] / kept[1]))


def in_test_fold(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Train on labelled rows outside the test fold, at most ``max_toxic`` and ``max_clean`` of them.

    The rows are those with the smallest digests of their ids, so a rerun takes the same ones;
    their number bounds all that reaches the driver. Rows without a label are left out; an id
    with several labels counts as toxic if one says so. Where the bounds keep unequal shares of
    the classes, the intercept is moved back, so that scores are those of the classes as the
    labels have them. With one class or none the model is a constant.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    y = y.filter(~in_test_fold(id_col)).withColumn("turn", F.md5(F.col(id_col).cast("string")))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shift = kept_log_odds(counts.get(1, 0), counts.get(0, 0), max_toxic, max_clean)
    some = [y.filter(F.col("y") == k).orderBy("turn", id_col).limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    chosen = some[0].unionByName(some[1]).select(F.col(id_col).alias("id"), "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    rows = materialize(rows, "labelled")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(0, b.num_rows, 256):
                held = _held(b.column(1).slice(row, 256).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, 256), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))], ["y", "held"]
                )

    sampled = arrow_map(rows, gather, [field("y", "int"), field("held", "array<bigint>")])
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        rate = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))) if rate else -8.0)
    seen = sampled.select("y", F.explode("held").alias("f")).groupBy("f").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    share = F.abs((F.col("t") + 0.5) / F.lit(toxic + 1.0) - (F.col("c") + 0.5) / F.lit(clean + 1.0))
    spread = F.sqrt((F.col("t") + F.col("c") + 1) / F.lit(toxic + clean + 1.0))
    best = seen.filter(F.col("t") + F.col("c") >= 3).orderBy(F.desc(share / spread), "f").limit(FEATURES)
    picked = best.select("f", "t", "c").collect()
    digests = np.array([r["f"] for r in picked], np.int64).view(np.uint64)
    by = np.argsort(digests)
    held_t, held_c = (np.array([r[k] for r in picked], float)[by] for k in ("t", "c"))
    digests = digests[by]
    # A feature enters by its log ratio, so one that only toxic texts hold counts even alone.
    ratio = np.log((held_t + 0.5) / (toxic + 1)) - np.log((held_c + 0.5) / (clean + 1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(texts: list[str | None]) -> pa.Array:
            return pa.array([np.flatnonzero(np.isin(digests, h)).astype(np.int32) for h in _held(texts)], pa.list_(pa.int32()))

        for b in batches:
            for row in range(0, b.num_rows, 256):
                texts = [t or "" for t in b.column(1).slice(row, 256).to_pylist()]
                other = [swapped(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, 256), places(texts), places([o if o is not None else t for o, t in zip(other, texts)]), pa.array([o is not None for o in other])],
                    ["y", "x", "swap", "named"],
                )

    kept = arrow_map(rows, project, [field("y", "int"), field("x", "array<int>"), field("swap", "array<int>"), field("named", "boolean")]).collect()

    kept.sort(key=lambda r: (r["y"], r["x"]))  # sums do not depend on the order rows arrive in
    n = len(digests)
    x, target = Rows.of([r["x"] for r in kept], n).scaled(ratio), np.array([r["y"] for r in kept], np.float64)
    named = [r for r in kept if r["named"]]
    change = Rows.of([r["x"] for r in named], n).plus(Rows.of([r["swap"] for r in named], n, -1.0)).scaled(ratio)
    weights, intercept = fit_linear(x, target, change)
    weights = weights * ratio
    return Model(digests, weights, intercept - shift)


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; the text alone decides the score.

    A null text scores as an empty one. Repeated rows and null ids come back as they are (a
    null id is in no fold); an empty table gives an empty table; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col), in_test_fold(id_col).alias("held_out"), F.col(text_col).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"]
            )

    return arrow_map(narrow, score, [*narrow.schema.fields[:2], field("score", "double"), field("predicted", "int")])


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a model trained on the labels does not reject."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at)) < 0.5))

    return arrow_map(docs, keep, docs.schema)
