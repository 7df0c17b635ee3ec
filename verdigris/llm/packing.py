"""Packing documents into as few fixed-length training sequences as possible.

Documents longer than a sequence are cut; everything then depends only on the histogram of
piece lengths (at most ``capacity`` numbers). The configuration program over that histogram,
minimize the number of sequences such that the chosen patterns hold every piece, is solved by
multiplicative weights to a bounded gap: a dynamic program over the capacity prices, for every
length, the best pattern that holds it; each round adds those patterns and lowers the weight of
what they cover (``solve_fractional``). Whole parts of the fullest patterns become patterns with counts and what is left is
placed best fit, longest first, still in counts; of several such roundings the one that needs
the fewest sequences is kept. The plan's size depends on the capacity, not on the number of
documents.

Pieces are then ranked within their length, and a piece's length and rank give its sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.running import ranked
from verdigris.llm.arrow import arrow_map, field, row_ids
from verdigris.llm.bpe_transducer import transducer
from verdigris.llm.words import slices
from verdigris.session import materialize

ROUNDS, STEP, LONG, PASSES, PARTS, SCALE, GAP, TINY = 24, 0.1, 0.05, 3, 8, 4096, 1e-3, 1e-9
SLACK, SHARES = (0.0, 0.05), (100, 90, 75, 50, 25, 10)  # roundings that are tried: least fill, percent of the whole patterns


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(rid, id, piece, start, length, ids_crc32) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for b in batches:
            for at, part in slices(b.column(2).fill_null("")):
                flat, n = machine.ids(part.to_pylist())
                first = np.cumsum(n) - n
                pieces = -(-(n + 1) // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
                start = piece * capacity
                length = np.minimum(capacity, n[row] + 1 - start)
                flat = flat.astype("<u4")
                closing = np.array([end_id], "<u4").tobytes()
                crc = np.empty(len(row), np.int64)
                for k, (r, s, m) in enumerate(zip(row, start, length)):
                    ids = flat[first[r] + s : min(first[r] + s + m, first[r] + n[r])]
                    value = zlib.crc32(ids)
                    crc[k] = zlib.crc32(closing, value) if len(ids) < m else value
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    ["rid", "id", "piece", "start", "length", "ids_crc32"],
                )

    narrow = docs.select(row_ids(docs).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = [*narrow.schema.fields[:2], field("piece", "int"), *[field(c, "bigint") for c in ("start", "length", "ids_crc32")]]
    return arrow_map(narrow, cut, schema)


# -- the plan, on the histogram alone ---------------------------------------------------


def _best_patterns(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over the capacity: best worth within c, and the last length put there (-1: none)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c], last[c] = value[c - 1], -2  # -2: as with one token less
        n = fitting[c]
        if n:
            options = (value[c - lengths[:n]] + worth[:n])[::-1]
            k = n - 1 - int(options.argmax())  # among equals the longest: short pieces fill gaps later
            options = options[::-1]
            if options[k] > value[c]:
                value[c], last[c] = options[k], k
    return value, last


def _pattern(last: np.ndarray, step: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    out, room = [], int(step[room])
    while room > 0:
        out.append(int(last[room]))
        room = int(step[room - int(lengths[last[room]])])
    return out


def _cover_rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], float]]:
    """Patterns (place, copies) with amounts that cover what is left: best fit in parts of 1 / SCALE."""
    place = {int(n): k for k, n in enumerate(lengths)}
    parts = np.ceil(left * SCALE - 1e-6).astype(np.int64)
    out = []
    for pattern, times in _best_fit({int(n): int(c) for n, c in zip(lengths, parts) if c > 0}, capacity):
        merged: Counter = Counter()
        for n, a in pattern:
            merged[place[n]] += a
        out.append((list(merged.items()), times / SCALE))
    return out


def _one_pass(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, base: np.ndarray
) -> tuple[list[dict[tuple, float]], float, np.ndarray]:
    """Solutions by the part of the rounds they take, a lower bound, and what all rounds leave open of each length."""
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    bound, found = 0.0, []

    def put(into: dict[tuple, float], pattern: list[tuple[int, int]], amount: float) -> None:
        key = tuple((int(lengths[j]), a) for j, a in sorted(pattern))
        into[key] = into.get(key, 0.0) + amount

    for n in range(rounds + 1):
        if n * PARTS % rounds == 0:  # the rest is covered by best fit from here
            done = dict(used)
            for pattern, amount in _cover_rest(lengths, counts - covered, capacity):
                put(done, pattern, amount)
            found.append(done)
        goal = counts * ((n + 1) / rounds)
        active = np.flatnonzero(counts - covered > TINY)
        if n == rounds or not len(active):
            break
        short = lengths[active]
        price = base[active] * short / capacity * (1 + LONG * short / capacity) * np.exp(-STEP * ((covered - goal) / counts)[active] * rounds)
        value, last = _best_patterns(short, price, capacity)
        bound = max(bound, float((counts[active] * price).sum() / value[capacity]))
        step = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))
        for at in range(len(active) - 1, -1, -1):
            k = active[at]
            if covered[k] >= goal[k] - TINY:
                continue  # other patterns of this round hold enough of it
            pattern = [(int(active[j]), a) for j, a in Counter([at, *_pattern(last, step, short, capacity - int(short[at]))]).items()]
            own = dict(pattern)[int(k)]
            amount = min((goal[k] - covered[k]) / own, *[(counts[j] - covered[j]) / a for j, a in pattern])
            if amount > TINY:
                put(used, pattern, amount)
                for j, a in pattern:
                    covered[j] = min(counts[j], covered[j] + a * amount)
    return found, bound, (counts - covered) / counts


def solve_fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float, float]:
    """Patterns (sorted (length, copies) pairs) and how often each is used; their sum; a lower bound of any solution.

    Multiplicative weights: a length's price is its share of the capacity, times exp(STEP) to the
    power of the rounds it lags behind its goal. The knapsack gives the best pattern of the
    prices, and with it for each length the best one that holds it. A round raises every
    length's coverage to its goal with those patterns, and never covers a length more than in
    full. Prices over the worth of the best pattern are a dual solution, so each round also
    bounds the program from below. What the rounds leave open is covered by best fit in small
    parts, after all of them or after a part of them, and another pass starts from prices raised
    by it, until one is within GAP of the bound. Of the solutions that need no more whole
    sequences than best fit alone, the one with the most rounds is kept.
    """
    bound = max(float((lengths * counts).sum()) / capacity, float(counts[2 * lengths > capacity].sum()))
    base, found, alone = np.ones(len(lengths)), [], 0.0
    for _ in range(PASSES):
        more, below, left = _one_pass(lengths, counts, capacity, rounds, base)
        found += [(sum(f.values()), -n, f) for n, f in enumerate(more)]
        bound, alone, base = max(bound, below), sum(more[0].values()), base * np.exp(left)
        if found[-1][0] <= bound * (1 + GAP):
            break
    good = [f for f in found if f[0] <= np.ceil(alone - 1e-6)]
    value, _, best = min(good, key=lambda f: (f[1], f[0]))
    return best, value, bound


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Longest lengths first into the tightest open sequences, equal sequences together."""
    open_at: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple, int]] = []

    def put(pattern: tuple, room: int, times: int) -> None:
        if not times:
            return
        if room == 0:
            done.append((pattern, times))
            return
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((pattern, times))

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put((), capacity, -(-todo // (capacity // length)))
                continue
            room = rooms[at]
            pattern, times = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
            copies = min(room // length, todo)
            full = min(times, todo // copies)
            put(pattern + ((length, copies),), room - length * copies, full)
            put(pattern, room, times - full)
            todo -= full * copies
    return done + [(p, t) for room in rooms for p, t in open_at[room] if p]


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Patterns of (length, copies) and how many sequences use each; together exactly the histogram."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    if not left:
        return []
    lengths = np.array(sorted(left), np.int64)
    used, _, _ = solve_fractional(lengths, np.array([left[int(k)] for k in lengths], float), capacity)
    filled = {p: sum(n * a for n, a in p) for p in used}
    fullest = max(filled.values())
    best: list[tuple[tuple, int]] | None = None
    for slack in SLACK:  # whole parts of patterns about as full as the fullest, longest pieces first
        whole = [(p, int(x)) for p, x in used.items() if int(x) and filled[p] >= fullest - slack * capacity]
        whole.sort(key=lambda u: (-filled[u[0]], -u[0][-1][0], u[0]))
        for cut in SHARES:
            rest, plan = dict(left), []
            for pattern, amount in whole[: -(-len(whole) * cut // 100)]:
                times = min(amount, *[rest[n] // a for n, a in pattern])
                if times:
                    plan.append((pattern, times))
                    for n, a in pattern:
                        rest[n] -= times * a
            plan += _best_fit({n: c for n, c in rest.items() if c}, capacity)
            if best is None or sum(t for _, t in plan) < sum(t for _, t in best):
                best = plan
    return best


class _Placer:
    """Sequence and offset of a piece from its length and its rank among the pieces of that length."""

    def __init__(self, plan: list[tuple[tuple, int]]):
        rows, base = [], 0
        for pattern, times in plan:
            offset = 0
            merged: Counter = Counter()
            for n, a in pattern:
                merged[n] += a
            for n, a in merged.items():
                rows.append((n, a, offset, times, base))
                offset += n * a
            base += times
        table = np.array(rows or [(0, 1, 0, 0, 0)], np.int64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        taken = table[:, 1] * table[:, 3]
        start = np.cumsum(taken) - taken
        first = np.searchsorted(table[:, 0], table[:, 0])
        self.table, self.start, self.sequences = table, start - start[first], base
        self.bounds = table[:, 0].astype(np.float64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank, length))
        key = np.rec.fromarrays([self.table[:, 0], self.start])
        want = np.rec.fromarrays([length[order], rank[order]], dtype=key.dtype)
        at = np.searchsorted(key, want, "right") - 1
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        n, copies, begin, _, base = self.table[at].T
        inside = rank[order] - self.start[at]
        sequence[order] = base + inside // copies
        offset[order] = begin + (inside % copies) * n
        return sequence, offset


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document is its ids and ``end_id``; a null text is empty and so one token. Pieces of a
    sequence lie without gaps from offset 0 and never exceed ``capacity``. Pieces of one length
    take their places in the order of the stored table, so a mix keeps its order. Repeated rows are
    packed each; an empty table gives an empty table; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    placer = _Placer(plan_packing(histogram, capacity))
    rows = ranked(pieces, [F.col("rid").asc(), F.col("piece").asc()], group=["length"])  # in the order of the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = placer(b.column(3).to_numpy(), b.column(5).to_numpy() - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    chosen = rows.select("id", "piece", "start", "length", "ids_crc32", "rank")
    schema = [field(names[0], chosen.schema["id"].dataType.simpleString()), *chosen.schema.fields[1:5], field("sequence_id", "bigint"), field("offset", "bigint")]
    return arrow_map(chosen, place, schema)
