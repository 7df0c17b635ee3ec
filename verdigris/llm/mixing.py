"""Mixing sources to target weights with a low-discrepancy schedule.

A mix is a sequence of slots, one block of equal token count each. Source s is owed q(s)
slots; laid end to end over the cumulative weights the owed slots are the integers 0..Q-1, and
integer j is the van der Corput point whose time is j with its bits reversed. A source's
integers are consecutive, so its times are spread evenly over the whole mix. The slots of a
source are ranked by time, and its rank r slot takes block r of the source's documents, which
are shuffled by a keyed digest, laid end to end and repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.running import ranked, running_sums
from verdigris.llm.arrow import arrow_map, fresh, row_ids
from verdigris.llm.words import Words, word_counts
from verdigris.session import materialize

BLOCK = 1024
WEIGHTS = (5, 2, 1)
CHUNK = 4096


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, rid, size); rid is the place of the row in the stored table ``docs``."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), row_ids(docs).alias("rid"), F.col(text_col).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(word_counts(b.column(3)))], ["id", "source", "rid", "size"])

    schema = T.StructType([*narrow.schema.fields[:3], T.StructField("size", T.LongType())])
    return materialize(arrow_map(narrow, count, schema), "mix-sizes")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target): capped shares of ``share`` times all words.

    Sources in code-point order (null last) take the repeating weights. What a source would
    get beyond ``cap`` times its size is shared out again by weight: with sources ordered by
    cap over weight, the capped ones come first, so one pass of running sums finds the level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    named = ranked(by_source, [F.col("source").asc_nulls_last()], name="nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = named.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("cap"))
    total = named.agg(F.sum("weight").alias("w"), (F.sum("source_size") * F.lit(share)).alias("budget"))
    level = running_sums(
        named, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"w_upto": F.col("weight"), "cap_upto": F.col("cap")}
    ).crossJoin(F.broadcast(total))  # one row
    # The level if all sources before this one are capped and this one is not.
    level = level.withColumn(
        "here", (F.col("budget") - F.col("cap_upto") + F.col("cap")) / (F.col("w") - F.col("w_upto") + F.col("weight"))
    )
    level = level.withColumn("capped", F.col("cap") <= F.col("here") * F.col("weight"))
    open_level = level.filter(~F.col("capped")).agg(F.min_by("here", F.struct("w_upto", F.col("cap_upto"))).alias("level"))
    return level.crossJoin(F.broadcast(open_level)).select(
        "source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).cast("double").alias("target")
    )


def _reversed_bits(j: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(j), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(source, slot, block_no): the time of every slot in the mix and the block it takes."""
    owed = goals.select("source", F.ceil(F.floor("target") / F.lit(block)).cast("long").alias("q")).filter("q > 0")
    laid = running_sums(owed, [F.col("source").asc_nulls_last()], {"hi": F.col("q")})
    laid = materialize(laid.select("source", (F.col("hi") - F.col("q")).alias("lo"), "hi"), "mix-owed")
    last = laid.agg(F.max("hi")).first()[0] or 1
    bits = (last - 1).bit_length()
    starts = laid.select("source", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(CHUNK).cast("long"))).alias("at"))
    points = starts.repartition("source", "at").select(
        "source", F.explode(F.sequence("at", F.least(F.col("at") + (CHUNK - 1), F.col("hi") - 1))).alias("j")
    )
    slots = points.select("source", _reversed_bits(F.col("j"), bits).alias("slot"))
    ranks = ranked(slots, [F.col("slot").asc()], group=["source"], name="nth")
    return ranks.select("source", "slot", (F.col("nth") - 1).alias("block_no"))


def mix(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The parts of the mix and the documents they come from.

    Parts: (rid, epoch, slot, at, words): how many words of which pass over the document a slot
    takes, and the place of the first one in the slot. Documents: (rid, id, source, size, source_size, target), one row per input row.
    A source's blocks give floor(target) words; the last one is cut there. Documents are
    shuffled by md5 of seed and id, then by id, size and place. Null texts and texts without
    words have size 0 and are never taken; null sources are one source; repeated rows are
    documents of their own; an empty table gives empty parts; other columns are ignored.
    """
    sizes = _sizes(docs, id_col, source_col, text_col)
    goals = materialize(targets(sizes, share, cap), "mix-targets")
    turn = F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    laid = running_sums(
        sizes.withColumn("turn", turn), [F.col("turn").asc(), F.col("id").asc(), F.col("size").asc(), F.col("rid").asc()], {"upto": F.col("size")}, ["source"]
    ).drop("turn")
    known = laid.join(goals, laid["source"].eqNullSafe(goals["source"]), "left").select(
        laid["*"], goals["source_size"], goals["target"]
    )
    known = materialize(known, "mix-docs")
    passes = known.select(
        "rid", "source", F.floor("target").alias("want"), F.explode(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))).alias("epoch"),
        (F.col("upto") - F.col("size")).alias("lo"), "upto", "source_size",
    ).select(
        "rid", "source", "epoch",
        (F.col("lo") + F.col("epoch") * F.col("source_size")).alias("lo"),
        F.least(F.col("upto") + F.col("epoch") * F.col("source_size"), "want").alias("hi"),
    ).filter("hi > lo")
    first, last = F.floor(F.col("lo") / F.lit(block)), F.floor((F.col("hi") - 1) / F.lit(block))
    pieces = passes.select("*", F.explode(F.sequence(first, last)).alias("block_no")).select(
        "rid", "source", "epoch", "block_no",
        (F.least("hi", (F.col("block_no") + 1) * F.lit(block)) - F.greatest("lo", F.col("block_no") * F.lit(block))).alias("words"),
        F.greatest(F.col("lo") - F.col("block_no") * F.lit(block), F.lit(0)).alias("at"),
    )
    slots = schedule(goals, block)
    on = pieces["source"].eqNullSafe(slots["source"]) & (pieces["block_no"] == slots["block_no"])
    return pieces.join(slots, on).select("rid", "epoch", "slot", "at", "words"), known.select("rid", "id", "source", "size", "source_size", "target")


def taken_words(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of the mix's input."""
    parts, known = mix(docs, id_col=id_col, **options)
    taken = parts.groupBy("rid").agg(F.sum("words").cast("long").alias("taken"))
    return known.join(taken, "rid", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options
) -> DataFrame:
    """The mix as rows of ``docs``: one row per document and pass, in all its columns.

    A document that a pass takes whole keeps its text; one at the end of its source's share
    keeps the words taken, up to the end of the last one. Rows come in the order of the mix: by
    the first slot that takes from the document, then by place in it. Null texts and texts
    without words are never taken, null sources are one source, repeated rows are documents of
    their own; an empty table gives an empty one, and clashing column names do no harm.
    ``docs`` must be a stored table.
    """
    parts, _ = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    taken = parts.groupBy("rid", "epoch").agg(
        F.sum("words").cast("long").alias("_words"), F.min(F.struct("slot", "at")).alias("_first")
    )
    columns = [F.col(c) for c in docs.columns]
    row, words_col, slot, place = (fresh(n, docs.columns) for n in ("_rid", "_words", "_slot", "_at"))
    rows = docs.select(*columns, row_ids(docs).alias(row))
    named = taken.select(
        F.col("rid").alias(row), F.col("_words").alias(words_col), F.col("_first.slot").alias(slot), F.col("_first.at").alias(place)
    )
    rows = rows.join(named, row).repartitionByRange(slot, place).sortWithinPartitions(slot, place).select(*columns, words_col)
    names = docs.columns
    at = names.index(text_col)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text, words = b.column(at), b.column(len(names)).to_numpy()
            table = Words(text)
            cut = words < table.count
            if cut.any():
                end = table.ends[(table.first + words - 1)[cut]] - table.offsets[:-1][cut]
                values = text.to_pylist()
                for row, stop in zip(cut.nonzero()[0], end):
                    values[row] = values[row].encode()[:stop].decode()
                text = pa.array(values, text.type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], text, *b.columns[at + 1 : -1]], names)

    return arrow_map(rows, trim, docs.schema)
