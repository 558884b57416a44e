"""Packing: concatenate tokenised documents and cut the stream into sequences of a fixed length.

Two passes. The first tokenises each input split and notes where every document lies within its split; the splits' totals
are then summed to give each split its place in one global stream. The second cuts the stream at multiples of the
sequence length: a document that crosses a cut gets one boundary record for each side. No row moves between splits.

Defined results: a null text is an empty one; every row of the input is packed, repeated rows and null or repeated doc_ids
included; an empty document still has its end id; an empty table gives no pieces; other columns are ignored. Only the last
sequence can be short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, prepare, with_bases
from fixwave.llm.tokens import binaries, tokenize_partition

PIECES = "doc_id {0}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut(length: int):
    """A mapInArrow function: pieces of the documents, cut at multiples of ``length`` of the global stream."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n_tokens").to_numpy()
            at = batch.column("base").to_numpy() + batch.column("part_offset").to_numpy()
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(at[row], seq * length)
            end = np.minimum((at + n)[row], (seq + 1) * length)
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4")  # pieces follow each other in it
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(begin - at[row]), pa.array(end - begin), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length)]
            yield pa.RecordBatch.from_arrays([*cols, binaries(ids, np.concatenate([[0], np.cumsum(end - begin)]))], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, doc_tokens, sequence_id, offset, ids as unsigned 32-bit)."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", "text").mapInArrow(tokenize_partition(tokenizer, end_id, False), f"doc_id {kind}, ids binary, n_tokens long, part int, part_offset long")
    tokens = scratch.save(tokens, "tokens")
    return with_bases(tokens, "part", "n_tokens", "base").mapInArrow(cut(length), PIECES.format(kind))


def sequences(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """The packed sequences: ids (padding left to the reader), the doc_ids in them, and the padding of each."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    joined: Column = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    used = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return parts.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), (F.lit(length) - used).alias("padding"))
