"""Token files: Parquet with one list of token ids per document, in ascending doc_id order.

The lists are dictionary-encoded (a vocabulary's ids fit a dictionary page, so an id takes 16 bits or fewer) and fall back
to delta encoding; doc_id and offsets are delta-encoded, row groups are of a stated size, and column and offset indexes
let a reader skip pages. Spark's own writer does it, so files appear only when their task commits, on any file system.

Defined results: a null text is an empty one and has only its end id; rows with a null doc_id come first and rows of one
doc_id are in order of their text; an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.llm.common import prepare, with_bases
from fixwave.llm.tokens import tokenize_partition


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, row_group: int = 64 << 20, page: int = 256 << 10) -> None:
    """Tokenise all documents and write them to ``path``, ordered within files and from file to file."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ordered.mapInArrow(tokenize_partition(tokenizer, end_id, True), f"doc_id {kind}, ids array<int>, n_tokens long, part int, part_offset long")
    layout = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "compression": "zstd"}
    tokens.write.options(**layout).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, start): reads no token page. ``start`` counts the ids of all documents before."""
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", "part", "part_offset")
    return with_bases(rows, "part", "n_tokens", "base").select("doc_id", "n_tokens", (F.col("base") + F.col("part_offset")).alias("start"))


def read_tokens(spark: SparkSession, path: str, first_id=None, last_id=None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of a range of doc_ids by the files' statistics and page indexes."""
    rows = spark.read.parquet(path)
    rows = with_bases(rows, "part", "n_tokens", "base") if first_id is None and last_id is None else rows.join(F.broadcast(with_bases(rows.select("part", "n_tokens"), "part", "n_tokens", "base").select("part", "base").distinct()), "part")
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows.select("doc_id", (F.col("base") + F.col("part_offset")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), the lengths and checksums taken from the lists themselves."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            raw = memoryview(lists.flatten().to_numpy().astype("<u4").tobytes())
            n = lists.value_lengths().to_numpy()
            ends = np.cumsum(n, dtype=np.int64) * 4
            crc = [zlib.crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
