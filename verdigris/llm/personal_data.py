"""Personal data in whole texts by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, schemes (``://``), plus signs and
digits. Each anchor goes to the parsers of its kind, which expand to the left and right as far
as the kind's characters reach and validate what they cover: labels of a mail domain, parts of
an address, Luhn sums, national lengths and check digits of an account. A parser never looks to
the left of its kind's last span, so the spans of a kind are the leftmost ones and never overlap,
and a text is read a bounded number of times whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.arrow import arrow_map, field
from verdigris.llm.words import slices

# Kinds in the order in which spans of one start are listed; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "account", "login")
BASE = KINDS[:4]
# Length of an account number (IBAN) by country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE LT LU XK", 21: "CH HR LI LV",
    22: "BG DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR QA UA", 30: "JO KW MU", 31: "MT",
}
_COUNTRY = "|".join(
    "(?:{})[0-9]{{2}}(?: ?[A-Z0-9]){{{}}}".format(names.replace(" ", "|"), n - 4) for n, names in ACCOUNT_LENGTHS.items()
)
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "account": rf"\b(?:{_COUNTRY})\b",
    "login": r"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D/?#@:]*:[^\x20\x09-\x0D/?#@]+@",
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SCHEME = _LETTERS | frozenset("0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+){0,3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(PATTERNS["phone"])
_ACCOUNT = re.compile(PATTERNS["account"], re.ASCII)
_LOGIN = re.compile(r"[^\x20\x09-\x0D/?#@:]*:[^\x20\x09-\x0D/?#@]+@")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def account_check(text: str) -> bool:
    """Whether an account number is 1 modulo 97 with its first four characters moved behind."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789"):
        machine.add_word(word, word[0])
    machine.make_automaton()
    return machine


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans in code points, sorted."""
    out = []
    email_end = ip_end = card_end = account_end = login_end = 0
    for at, kind in _anchors().iter(text):
        if kind == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, at + 1) if start < at else None
            if found:
                email_end = found.end()
                out.append((start, 0, email_end))
        elif kind == "+":
            found = _PHONE.match(text, at)
            if found and 9 <= len(_NO_DIGIT.sub("", found[0])) <= 15:
                out.append((at, 3, found.end()))
        elif kind == ":":
            at -= 2
            start, letter = at, at
            while start > login_end and text[start - 1] in _SCHEME:
                start -= 1
                if text[start] in _LETTERS:
                    letter = start
            found = _LOGIN.match(text, at + 3) if letter < at else None
            if found:
                login_end = found.end()
                out.append((letter, 5, login_end))
        else:
            if at >= ip_end:
                found = _NUMBERS.match(text, at)
                ip_end = found.end()
                parts = found[0].split(".")
                if len(parts) == 4 and all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in parts):
                    out.append((at, 1, ip_end))
            if at >= card_end:
                found = _DIGITS.match(text, at)
                card_end = found.end()
                if card_end - at >= 12:
                    digits = _NO_DIGIT.sub("", found[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, card_end))
            if at - 2 >= account_end:
                found = _ACCOUNT.match(text, at - 2)
                if found:
                    account_end = found.end()
                    if account_check(found[0]):
                        out.append((at - 2, 4, account_end))
    out.sort()
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: an array of (kind, start, end) by start, then kind.

    Places are code points of the whole text, ends exclusive. Base kinds: email, ip (four parts
    of at most 255), card (12 to 19 digits with a right Luhn sum), phone (9 to 15 digits); each
    is leftmost and non-overlapping within its kind and what fails is dropped without another
    try. Added kinds: account (IBAN of its country's length, single spaces allowed, check digits
    right) and login (a URL up to the at-sign behind its user name and password). Null and empty
    texts have no spans. Repeated rows and null ids come back as they are; an empty table gives
    an empty table; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(KINDS)
        for b in batches:
            lists, flat = [np.zeros(1, np.int32)], []
            for _, part in slices(b.column(1).fill_null("")):
                found = [spans_of(t) for t in part.to_pylist()]
                lists.append(np.cumsum([len(f) for f in found], dtype=np.int32) + lists[-1][-1])
                flat += [s for f in found for s in f]
            start, kind, end = np.array(flat, np.int64).reshape(-1, 3).T
            spans = pa.StructArray.from_arrays([names.take(pa.array(kind)), pa.array(start), pa.array(end)], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(lists)), spans)], [id_col, "spans"])

    id_field = field(id_col, narrow.schema["id"].dataType.simpleString())
    return arrow_map(narrow, find, [id_field, field("spans", "array<struct<kind:string,start:bigint,end:bigint>>")])


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row, from ``personal_data``.

    The counts and the digest are those of the base kinds, ``spans`` lists all kinds. A text
    without spans has the digest of nothing and an empty list.
    """
    found = personal_data(docs, id_col, text_col)

    def of(kinds: tuple[str, ...]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of((k,))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(span_list(of(BASE)), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
