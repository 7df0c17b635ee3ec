"""Fill-in-the-middle forms of whole texts, cut at token borders through a learned rank index.

A token is a word with the white space before it, or white space at the end of the text. A
document's draws come from a keyed digest of its id, so any run on any cluster cuts alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.arrow import arrow_map, field
from verdigris.llm.rank_index import RankIndex
from verdigris.llm.words import Words, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_col: Column, seed: int = 42) -> list[Column]:
    """Four numbers below 2**32 from the digest of seed and id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def token_borders(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset, within its text, of every token border from 0 on, and where each text's begin.

    A text of n tokens has n + 1 borders.
    """
    size = np.diff(words.offsets)
    last_word = np.zeros(len(size), np.int64)
    some = words.count > 0
    last_word[some] = words.ends[(words.first + words.count - 1)[some]] - words.offsets[:-1][some]
    trailing = size > last_word
    n = words.count + trailing
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.zeros(int(first[-1]), np.int64)
    inside = np.arange(len(words.starts)) - np.repeat(words.first, words.count)
    out[first[words.row] + 1 + inside] = words.ends - words.offsets[words.row]
    out[first[1:][trailing] - 1] = size[trailing]
    return out, first


def fill_in_middle(
    docs: DataFrame, rate: int = 50, suffix_first: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``rate`` percent of the documents change form, ``suffix_first`` percent of those start with
    the suffix (spm), the others with the prefix (psm). A text that is empty, null or holds one
    of the three marks stays plain, with null lengths. Cuts fall on token borders drawn by id:
    rows with one id and one text give one result, null ids draw as an id without digits. An
    empty table gives an empty table; other columns are ignored.
    """
    h = draws(F.col(id_col), seed)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(f"h{k}") for k, c in enumerate(h)])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, h3, h4 = (c.to_numpy() for c in b.columns[2:])
            for at, part in slices(b.column(1)):
                words = Words(part)
                borders, first = token_borders(words)
                index = RankIndex(borders, first)
                rows = np.arange(len(part))
                n = np.diff(first) - 1
                here = slice(at, at + len(part))
                u, v = h1[here] % (n + 1), h2[here] % (n + 1)
                low, high = index(rows, np.minimum(u, v)), index(rows, np.maximum(u, v))
                begin = words.offsets[:-1]
                points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points before a byte
                prefix, middle = points[begin + low] - points[begin], points[begin + high] - points[begin + low]
                plain = (n == 0) | (h3[here] % 100 >= rate)
                spm = h4[here] % 100 < suffix_first
                out, form = [], []
                whole = words.data.tobytes()
                for k, (a, c, z) in enumerate(zip((begin + low).tolist(), (begin + high).tolist(), words.offsets[1:].tolist())):
                    text = whole[words.offsets[k] : z]
                    if plain[k] or b"<P>" in text or b"<S>" in text or b"<M>" in text:
                        plain[k] = True
                        form.append("plain")
                        out.append(text)
                        continue
                    p, m, s = whole[words.offsets[k] : a], whole[a:c], whole[c:z]
                    form.append("spm" if spm[k] else "psm")
                    out.append(b"".join([b"<S>", s, b"<P>", p, b"<M>", m] if spm[k] else [b"<P>", p, b"<S>", s, b"<M>", m]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(n), pa.array(form), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    names,
                )

    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = ["bigint", "string", "bigint", "bigint", "string"]
    return arrow_map(narrow, transform, [field(id_col, narrow.schema["id"].dataType.simpleString()), *map(field, names[1:], kinds)])


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` of the given form was made from.

    Marks cannot arise where a part meets a mark, so the first ones are the real ones.
    """

    def place(mark: str, after: Column) -> Column:
        return F.call_function("locate", F.lit(mark), output, after)

    def between(start: Column, end: Column) -> Column:
        return F.substr(output, start, end - start)

    one, four, rest = F.lit(1), F.lit(4), F.length(output) + 1
    s = place(SUFFIX, one)
    m = place(MIDDLE, s)
    psm = F.concat(between(four, s), between(m + 3, rest), between(s + 3, m))
    p = place(PREFIX, one)
    n = place(MIDDLE, p)
    spm = F.concat(between(p + 3, n), between(n + 3, rest), between(four, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``fill_in_middle`` with the digests of its output and of the text rebuilt from it in place of the output."""
    made = fill_in_middle(docs, id_col=id_col, text_col=text_col, **options)
    return made.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
