"""Token counts of whole texts by a compiled byte-pair transducer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdigris.llm.bpe_transducer import transducer
from verdigris.llm.arrow import arrow_map
from verdigris.llm.words import slices


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in one narrow pass.

    ``vocabulary`` is the path of the tokenizer file on every executor. Counts equal those of
    the file's library without added special tokens; special strings inside a text count as
    one token each. A null text counts as empty (0 bytes, 0 tokens); an empty table gives an
    empty table; repeated rows and null ids come back as they are; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = np.zeros(len(texts), np.int64)
            for at, part in slices(texts):
                n[at : at + len(part)] = machine.counts(part.to_pylist())
            size = pc.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names)

    narrow = docs.select(id_col, text_col)
    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    schema = T.StructType(
        [narrow.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )
    return arrow_map(narrow, count, schema)
