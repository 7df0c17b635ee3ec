"""URL rules by a sorted array of 64-bit digests.

A rule is a host and a path prefix; it fits that host and its subdomains. Rule digests lie
sorted in a file that workers memory-map, next to the full rule strings. A URL offers one key
per host suffix and rule path length; all keys of a batch are probed at once by binary search,
and a hit counts only if the stored string equals the key.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.arrow import arrow_map

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WHAT = np.dtype([("start", "<i8"), ("size", "<i4"), ("block", "<i4")])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def write_rules(rules: list[tuple[str, str, str]], folder: str) -> str:
    """Store (verdict, host, path) rules: digests in order, what belongs to each, the strings."""
    keys = [(h.translate(_LOWER) + p).encode() for _, h, p in rules]
    records = np.zeros(len(rules), _WHAT)
    sizes = np.array([len(k) for k in keys], np.int64)
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8")
    records["start"], records["size"] = np.cumsum(sizes) - sizes, sizes
    records["block"] = [v == "block" for v, _, _ in rules]
    order = np.argsort(digests, kind="stable")
    path = os.path.join(folder, f"rules-{xxhash.xxh64_hexdigest(b'|'.join(keys) + records.tobytes())}.bin")
    with open(path, "wb") as f:
        f.write(np.int64(len(rules)).tobytes())
        f.write(digests[order].tobytes())
        f.write(records[order].tobytes())
        f.write(b"".join(keys))
    return path


class RuleArray:
    """Probes a mapped rule file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")  # read through the map, shared by all workers of a machine
        self.records = raw[8 + 8 * n : 8 + (8 + _WHAT.itemsize) * n].view(_WHAT)
        self.strings = raw[8 + (8 + _WHAT.itemsize) * n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Record of each key, -1 where no stored string equals it."""
        want = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, want)
        out = np.full(len(keys), -1, np.int64)
        for k in np.flatnonzero(at < len(self.digests)):
            i = at[k]
            while i < len(self.digests) and self.digests[i] == want[k]:
                start, size = int(self.records["start"][i]), int(self.records["size"][i])
                if self.strings[start : start + size].tobytes() == keys[k]:
                    out[k] = i
                    break
                i += 1
        return out


_SENT: dict[tuple, str] = {}


def _sent(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Name under which every worker finds the rule file; sent once per application and list."""
    key = spark.sparkContext.applicationId, tuple(rules)
    if key not in _SENT:
        stored = write_rules(rules, tempfile.mkdtemp(prefix="rules-"))
        spark.sparkContext.addFile(stored)
        _SENT[key] = os.path.basename(stored)
    return _SENT[key]


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``rules`` are (verdict, host, path prefix); the longest fitting rule (host and path
    together) wins, and without one ``rule`` is null and ``verdict`` the default: a list of
    digests names only what it knows. A null URL or one without ``://`` has empty host and path
    and fits no rule. Repeated rows and null ids come back as they are; other columns are ignored.
    """
    name = _sent(pages.sparkSession, rules)
    lengths = sorted({len(p.encode()) for _, _, p in rules})
    longest = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    host, path = host_and_path(F.col(url_col))
    narrow = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = RuleArray(SparkFiles.get(name))
        for b in batches:
            keys, owner, cut = [], [], []
            for row, (h, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                labels, path_bytes = h.split("."), p.encode()
                for k in range(max(0, len(labels) - longest), len(labels)):
                    suffix = ".".join(labels[k:]).encode()
                    for n in lengths:
                        if n <= len(path_bytes):
                            keys.append(suffix + path_bytes[:n])
                            owner.append(row)
                            cut.append(len(suffix))
            found = array.find(keys)
            best: dict[int, tuple[int, int]] = {}
            for k in np.flatnonzero(found >= 0):
                best[owner[k]] = max(best.get(owner[k], (-1, -1)), (len(keys[k]), int(k)))
            rule: list[str | None] = [None] * b.num_rows
            verdict = [default] * b.num_rows
            for row, (_, k) in best.items():
                rule[row] = keys[k].decode()
                verdict[row] = "block" if array.records["block"][found[k]] else "allow"
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [id_col, "host", "path", "rule", "verdict"]
            )

    schema = T.StructType([*narrow.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return arrow_map(narrow, judge, schema)
