"""Byte-pair encoding as a deterministic transducer, compiled from a tokenizer file.

A word's tokens are found left to right. After ``i`` bytes let ``T(i)`` be the last token of
the encoding of those bytes and ``N(i)`` its length. A token ``t`` that ends at ``i`` and is
``l`` bytes long is ``T(i)`` exactly if the pair ``T(i-l), t`` encodes to itself, and then
``N(i) = N(i-l) + 1``. Only starts from which some token can still be completed matter, so a
finite state holds their last tokens and relative counts. A transition reads one byte (or the
last byte of a word, which takes the end-of-word tokens) and is annotated with the change of
the token count. States are compiled when first met and shared by all later texts of the
worker process.

Texts become one byte buffer. Word starts reset the machine, so the pieces between them run
side by side, one vector step per byte. Words beyond LANE bytes are cut into chunks: each
chunk runs from a guessed entry state, then entries are replaced by the exit of the chunk
before, chunk after chunk in parallel, until no entry changes; the counts of the chunks add up.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

LANE = 512
MAX_STATES, MAX_WORDS, MAX_PAIRS = 120_000, 400_000, 1_000_000  # some 400 MB in a worker
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
END = "</w>"


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Lookup:
    """Vectorized open addressing: int64 keys (not -1) to int64 values."""

    def __init__(self, room: int = 1 << 16):
        self._clear(room)

    def _clear(self, room: int) -> None:
        self.size, self.mask = 0, room - 1
        self.keys, self.values = np.full(room, -1, np.int64), np.zeros(room, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where the key is absent."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot_left = (slot[left] + 1) & self.mask
            slot[left] = slot_left
            there = self.keys[slot_left]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot_left[hit]]
            left = left[~hit & (there != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and absent."""
        if 2 * (self.size + len(keys)) > self.mask + 1:
            full = self.keys != -1
            old = self.keys[full], self.values[full]
            room = self.mask + 1
            while 2 * (self.size + len(keys)) > room:
                room *= 2
            self._clear(room)
            self.put(*old)
        self.size += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several on one slot the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.mask


class Transducer:
    """Counts and ids of a byte-level word vocabulary with an end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError(f"{path}: not a BPE vocabulary with {END}")
        back = {s: b for b, s in enumerate(_byte_symbols())}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

        def key(symbol: str) -> tuple[bytes, bool]:
            ends = symbol.endswith(END)
            return bytes(back[c] for c in (symbol[: -len(END)] if ends else symbol)), ends

        vocab = model["vocab"]
        keys = {i: key(s) for s, i in vocab.items()}
        self._id = {k: i for i, k in keys.items()}
        self.length = np.zeros(max(keys) + 1, np.int64)
        for i, (b, _) in keys.items():
            self.length[i] = len(b)
        self._text = {i: k for i, k in keys.items()}
        self._merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self._prefixes = {b[:n] for b, _ in keys.values() for n in range(len(b) + 1)}
        # A marked token can still grow out of its whole text without the mark.
        self._open = {b[:n] for b, ends in keys.values() for n in range(len(b))}
        self._pair_ok: dict[tuple[int, int], bool] = {}
        self._self_ok: dict[int, bool] = {}
        self._reset()
        self._classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _reset(self) -> None:
        self._states, self._live = {}, []
        self._token = np.full(4096, -1, np.int32)  # the token a state ends with
        self._step = Lookup()  # (state, byte, last) to (next state or last token, gained tokens)
        self._state(((b"", -1, 0),), -1)
        self._words = Lookup()  # words of up to 7 bytes to (count, place in the pool)
        self._pool, self._pool_size = np.zeros(1 << 16, np.int32), 0

    # -- compiling ---------------------------------------------------------------------

    def _encode(self, ids: list[int]) -> list[int]:
        none = (1 << 60, -1)
        ids = list(ids)
        steps = [self._merge.get(p, none) for p in zip(ids, ids[1:])]
        while steps:
            best = min(steps)
            if best is none:
                break
            k = steps.index(best)
            ids[k : k + 2] = [best[1]]
            del steps[k]
            for j in (k - 1, k):
                if 0 <= j < len(steps):
                    steps[j] = self._merge.get((ids[j], ids[j + 1]), none)
        return ids

    def _symbols(self, token: int) -> list[int]:
        text, ends = self._text[token]
        return [self._id[text[k : k + 1], ends and k == len(text) - 1] for k in range(len(text))]

    def _fits(self, before: int, token: int) -> bool:
        if before < 0:
            if token not in self._self_ok:
                self._self_ok[token] = self._encode(self._symbols(token)) == [token]
            return self._self_ok[token]
        pair = before, token
        if pair not in self._pair_ok:
            self._pair_ok[pair] = self._encode(self._symbols(before) + self._symbols(token)) == [before, token]
        return self._pair_ok[pair]

    def _state(self, live: tuple, token: int) -> int:
        at = self._states.get(live)
        if at is None:
            at = self._states[live] = len(self._live)
            self._live.append(live)
            if at == len(self._token):
                self._token = np.concatenate([self._token, np.full(at, -1, np.int32)])
            self._token[at] = token
        return at

    def _compile(self, state: int, byte: int, last: bool) -> int:
        """Next state (after a last byte: the word's last token) and gain, as one number."""
        c = bytes([byte])
        for text, before, count in self._live[state]:
            token = self._id.get((text + c, last))
            if token is not None and self._fits(before, token):
                gain = count + 1
                break
        else:
            raise ValueError("the vocabulary does not cover every byte")
        if last:
            return token << 8 | (gain + 128)
        live = [(text + c, before, count - gain) for text, before, count in self._live[state] if text + c in self._open]
        live.append((b"", token, 0))
        return self._state(tuple(live), token) << 8 | (gain + 128)

    def _go(self, state: np.ndarray, byte: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        keys = (state << 9) | (byte.astype(np.int64) << 1) | last
        out = self._step.get(keys)
        missing = out < 0
        if missing.any():
            new = np.unique(keys[missing])
            self._step.put(new, np.array([self._compile(int(k >> 9), int(k >> 1) & 255, last) for k in new], np.int64))
            out = self._step.get(keys)
        return out >> 8, (out & 255) - 128

    # -- running -----------------------------------------------------------------------

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Normalized parts between special strings; the text each belongs to; the special id after it or -1."""
        parts, owner, after = [], [], []
        for row, text in enumerate(texts):
            cut = [text]
            if self._special_split is not None and "<" in text:
                cut = self._special_split.split(text)
            for k in range(0, len(cut), 2):
                parts.append(self._normal(cut[k]))
                owner.append(row)
                after.append(self.specials[cut[k + 1]] if k + 1 < len(cut) else -1)
        return parts, np.array(owner, np.int64), np.array(after, np.int64)

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if max(text) < "Ā":  # composed already, one-to-one lower case
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte buffer, word starts, word ends, and the part of each word."""
        encoded = [p.encode("utf-8", "surrogatepass") for p in parts]
        data = np.frombuffer(b" ".join(encoded) + b" " * 8, np.uint8)
        sizes = np.array([len(e) + 1 for e in encoded], np.int64)
        kind = self._class(data)
        cont = (data & 0xC0) == 0x80
        if cont.any():
            lead = np.flatnonzero(data >= 0xC0)
            b = data.astype(np.int64)
            b0, b1, b2, b3 = b[lead], b[lead + 1], b[lead + 2], b[lead + 3]
            two = ((b0 & 31) << 6) | (b1 & 63)
            three = ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)
            four = ((b0 & 7) << 18) | ((b1 & 63) << 12) | ((b2 & 63) << 6) | (b3 & 63)
            point = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
            k = self._class(point)
            kind[lead] = k
            kind[lead + 1] = k
            wide = b0 >= 0xE0
            kind[lead[wide] + 2] = k[wide]
            wide = b0 >= 0xF0
            kind[lead[wide] + 3] = k[wide]
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        start = (kind != SPACE) & ~cont & ((kind != before) | (kind == NUMBER))
        quote = np.flatnonzero(start & (data == 39))
        quote = quote[quote + 3 < len(data)]
        if len(quote):
            n1, n2 = data[quote + 1], data[quote + 2]
            short = np.isin(n1, np.frombuffer(b"stmd", np.uint8))
            long = ((n1 == 114) & (n2 == 101)) | ((n1 == 118) & (n2 == 101)) | ((n1 == 108) & (n2 == 108))
            hit = quote[short | long]
            width = np.where(short, 2, 3)[short | long]
            start[hit + 1] = False
            follow = hit + width
            start[follow[(kind[follow] != SPACE) & ~cont[follow]]] = True
        filled = kind != SPACE
        stop = np.zeros(len(data), bool)
        stop[1:] = filled[:-1] & (start[1:] | ~filled[1:])
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
        bounds = np.cumsum(sizes)
        return data, starts, ends, np.searchsorted(bounds, starts, "right")

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, trace: np.ndarray | None) -> np.ndarray:
        """Tokens of each word; trace, if given, gets the token that ends at each byte."""
        size = ends - starts
        lanes = np.maximum(1, -(-size // LANE))
        word = np.repeat(np.arange(len(starts)), lanes)
        first = np.cumsum(lanes) - lanes
        nth = np.arange(len(word)) - first[word]
        lo = starts[word] + nth * LANE
        hi = np.minimum(lo + LANE, ends[word])
        closes = hi == ends[word]
        entry, leave, gain = (np.zeros(len(word), np.int64) for _ in range(3))
        todo = np.arange(len(word))
        while len(todo):
            leave[todo], gain[todo] = self._lockstep(data, lo[todo], hi[todo], closes[todo], entry[todo], trace)
            inner = np.flatnonzero(nth > 0)
            todo = inner[entry[inner] != leave[inner - 1]] if len(inner) else inner
            entry[todo] = leave[todo - 1]
        return np.bincount(word, gain, len(starts)).astype(np.int64)

    def _lockstep(self, data, lo, hi, closes, entry, trace):
        body = hi - lo - closes
        order = np.argsort((LANE - body).astype(np.uint16), kind="stable")  # lanes still running are a prefix
        lo, body, ended = lo[order], body[order], closes[order]
        state, gain = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        running = len(body) - np.cumsum(np.bincount(body))[:-1]
        for k, n in enumerate(running):
            at = lo[:n] + k
            to, more = self._go(state[:n], data[at], False)
            state[:n] = to
            gain[:n] += more
            if trace is not None:
                trace[at] = self._token[to]
        shut = np.flatnonzero(ended)
        if len(shut):
            at = lo[shut] + body[shut]
            token, more = self._go(state[shut], data[at], True)
            gain[shut] += more
            if trace is not None:
                trace[at] = token
            state[shut] = 0
        out_state, out_gain = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        out_state[order], out_gain[order] = state, gain
        return out_state, out_gain

    def _word_ids(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, word after word, and how many each has."""
        trace = np.full(len(data), -1, np.int32)
        count = self._run(data, starts, ends, trace)
        flat = np.empty(int(count.sum()), np.int32)
        at, slot, begin = ends - 1, np.cumsum(count) - 1, starts
        while len(at):  # from each word's end back through its tokens
            token = trace[at]
            flat[slot] = token
            at = at - self.length[token]
            go = at >= begin
            at, slot, begin = at[go], slot[go] - 1, begin[go]
        return flat, count

    def _known(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words have up to 7 bytes, their counts, and their ids' places in the pool."""
        short = ends - starts < 8
        lo, size = starts[short], (ends - starts)[short]
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        keys = (eight[lo] & ((np.uint64(1) << (size * 8).astype(np.uint64)) - np.uint64(1))).view(np.int64) | size << 56
        found = self._words.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            pick = missing[one]
            flat, count = self._word_ids(data, lo[pick], lo[pick] + size[pick])
            while self._pool_size + len(flat) > len(self._pool):
                self._pool = np.concatenate([self._pool, np.zeros(len(self._pool), np.int32)])
            self._pool[self._pool_size : self._pool_size + len(flat)] = flat
            place = self._pool_size + np.cumsum(count) - count
            self._pool_size += len(flat)
            self._words.put(new, place << 8 | count)
            found = self._words.get(keys)
        return short, found & 255, found >> 8

    def _bounded(self) -> None:
        """Start again when the compiled part has outgrown its bound; results do not depend on it."""
        if len(self._live) > MAX_STATES or self._words.size > MAX_WORDS:
            self._reset()
        if len(self._pair_ok) > MAX_PAIRS:  # dear to find out again, and small
            self._pair_ok.clear()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        self._bounded()
        parts, owner, after = self.pieces(texts)
        total = np.bincount(owner[after >= 0], minlength=len(texts)).astype(np.int64)
        if parts:
            data, starts, ends, part = self.words(parts)
            per_word = np.empty(len(starts), np.int64)
            short, per_word[short], _ = self._known(data, starts, ends)
            per_word[~short] = self._run(data, starts[~short], ends[~short], None)
            total += np.bincount(owner[part], per_word, len(texts)).astype(np.int64)
        return total

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has."""
        self._bounded()
        parts, owner, after = self.pieces(texts)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data, starts, ends, part = self.words(parts)
        per_word, source = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        short, per_word[short], source[short] = self._known(data, starts, ends)
        flat, per_word[~short] = self._word_ids(data, starts[~short], ends[~short])
        source[~short] = self._pool_size + np.cumsum(per_word[~short]) - per_word[~short]
        first = np.cumsum(per_word) - per_word
        out = np.concatenate([self._pool[: self._pool_size], flat])[np.repeat(source - first, per_word) + np.arange(int(per_word.sum()))]
        per_part = np.bincount(part, per_word, len(parts)).astype(np.int64)
        marks = after >= 0
        if marks.any():
            out = np.insert(out, np.cumsum(per_part)[marks], after[marks])
            per_part = per_part + marks
        return out, np.bincount(owner, per_part, len(texts)).astype(np.int64)

    def _class(self, points: np.ndarray) -> np.ndarray:
        """Space, letter, number or other, as the library itself splits; asked per block of 256 code points."""
        out = self._classes[points]
        if (out == UNKNOWN).any():
            for block in np.unique(points[out == UNKNOWN].astype(np.int64) >> 8):
                codes = [p for p in range(block << 8, (block + 1) << 8) if not 0xD800 <= p < 0xE000]
                self._classes[block << 8 : (block + 1) << 8] = OTHER
                spans: dict[int, list[int]] = {}
                for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str("".join(f"{chr(p)}{chr(p)}a " for p in codes)):
                    spans.setdefault(a // 4, []).append(b - a)
                kinds = {(3,): LETTER, (1, 1, 1): NUMBER, (2, 1): OTHER}
                for k, p in enumerate(codes):
                    self._classes[p] = kinds.get(tuple(spans.get(k, ())), SPACE)
            out = self._classes[points]
        return out

    @property
    def n_states(self) -> int:
        return len(self._live)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One compiled machine per worker process and file."""
    return Transducer(path)
