"""Exact repeats: remove every byte that a repeated string of a fixed length covers, by bucket-pointer refinement.

Every window of ``length`` bytes is first filed in the bucket of its least q-gram, so equal windows are in one bucket; the
windows in a row that have one least q-gram are a run, a row of up to length - q + 1 windows. A bucket's identifier is then
refined step by step, as a suffix sort refines buckets by the buckets that its pointers lead to at later offsets:

- a block of neighbouring windows has the identifier of what all its windows share (of a run, that is its least q-gram);
- a step cuts blocks into blocks of a fraction of the windows (WIDTHS), which share more bytes: each takes the identifier of
  the block it was cut from, updated with those of the bytes at the offsets before and after that it shares besides;
- blocks are sorted into buckets by the identifiers of this step. A block alone in its bucket can't repeat and goes; a bucket
  whose blocks are equal as a whole is settled, and all their windows are repeated; of other buckets blocks that equal another
  as a whole are settled too, and one of each kind is kept for the others to meet; buckets that hold only such are done;
- what is left goes on to the next step with the identifiers of this one, down to single windows.

Identifiers are 64-bit hashes, built from those of the step before; what is called equal agrees in two of them (bucket and
whole block), so that about 2^-128 of unlike pairs would be taken for equal. All buckets are counted with partial aggregation
and met by joins, so that none is ever held by one task.

Defined results: a null text is an empty one; a text shorter than ``length`` keeps all its bytes; matches don't cross
documents, and copies within one document, overlapping or not, count; repeated rows are copies of each other; rows with null
or repeated doc_ids are told apart by their text; an empty table gives an empty frame; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, prepare, slices
from fixwave.llm.rolling import Rolling, leftmost_minimum, mix

SLICE = 1 << 20
WIDTHS = (16, 4, 1)  # windows in a block, step by step; each divides the one before


def _concatenated(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts that are long enough; which texts those are; where each begins and its size."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    which = np.array([i for i, r in enumerate(raw) if len(r) >= length], np.int64)
    size = np.array([len(raw[i]) for i in which], np.int64)
    return np.frombuffer(b"".join(raw[i] for i in which), np.uint8), which, np.cumsum(size) - size, size


def _runs(length: int, q: int):
    """A mapInArrow function: runs of windows filed under one q-gram: bucket, bucket of the run, place."""

    def run(batches):
        for batch in slices(batches, size=SLICE):
            data, which, begin, size = _concatenated(batch.column("text").to_pylist(), length)
            if not len(which):
                continue
            grams = Rolling(data).all(q)
            at = leftmost_minimum(grams, length - q + 1)
            edge = np.zeros(len(data) + 1, np.int32)
            edge[begin] += 1
            edge[begin + size - length + 1] -= 1  # windows that begin after this would leave the text
            valid = np.cumsum(edge)[: len(at)] > 0
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
            new[begin[begin < len(at)]] = True
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            first, last = first[valid[first]], last[valid[first]]
            anchor = at[first]
            shape = (anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
            whole = mix(Rolling(data, 1).of(first, last + length) ^ mix(shape))
            owner = np.searchsorted(begin, first, side="right") - 1
            rows = pa.array(which[owner])
            cols = [batch.column("doc_id").take(rows), batch.column("mark").take(rows), pa.array(grams[anchor].view(np.int64)), pa.array(whole.view(np.int64)), pa.array((first - begin[owner]).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array((anchor - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "bucket", "run", "first", "more", "lead"])

    return run


def _snippets(length: int):
    """A mapInArrow function: the bytes that the windows of each chosen run cover."""

    def run(batches):
        for batch in slices(batches, size=SLICE):
            lists = batch.column("runs")
            flat = lists.flatten()
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            cut = [raw[r][a : a + m + length] for r, a, m in zip(rows.tolist(), flat.field("first").to_pylist(), flat.field("more").to_pylist())]
            at = pa.array(rows)
            cols = [batch.column("doc_id").take(at), batch.column("mark").take(at), *[flat.field(c) for c in ("first", "more", "lead", "open", "bucket")], pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "first", "more", "lead", "open", "bucket", "snippet"])

    return run


def _refined(length: int, q: int, before: int, width: int):
    """A mapInArrow function: the blocks of ``width`` windows within chosen blocks of ``before`` windows (0: whole runs), with
    their refined identifiers.

    Blocks are counted from the window that begins with the run's least q-gram, backwards, so that equal windows are in blocks
    of one number; block b of w windows holds the windows that begin up to w - 1 bytes before ``lead`` - w * b. Those of them
    that the run has not are left out of the block, but not of what it shares.
    """

    def run(batches):
        for batch in slices(batches, "snippet", SLICE):
            data = np.frombuffer(b"".join(batch.column("snippet").to_pylist()), np.uint8)
            more, lead = (batch.column(c).to_numpy().astype(np.int64) for c in ("more", "lead"))
            begin = np.cumsum(more + length) - more - length
            lists = batch.column("blocks")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            block, bucket, unseen = flat.field("block").to_numpy().astype(np.int64), flat.field("bucket").to_numpy().view(np.uint64), flat.field("open").to_numpy(zero_copy_only=False)
            if before:
                shared = lead[row] - before * block, lead[row] - before * block - before + 1 + length  # what the block's windows share
                shared = shared[0], np.maximum(shared[1], shared[0])
                parts = before // width
                low, high = block * parts, block * parts + parts - 1
            else:
                shared = lead[row], lead[row] + q
                low, high = -((more - lead)[row] // width) - ((more - lead)[row] % width > 0), lead[row] // width
            n = high - low + 1
            at = np.repeat(np.arange(len(row)), n)
            number = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            row, bucket, unseen, old = row[at], bucket[at], unseen[at], (shared[0][at], shared[1][at])
            stop = lead[row] - width * number  # the last window of the block, nominally
            first, last = np.maximum(stop - width + 1, 0), np.minimum(stop, more[row])
            keep = first <= last
            row, number, bucket, unseen, stop, first, last = (x[keep] for x in (row, number, bucket, unseen, stop, first, last))
            old = old[0][keep], old[1][keep]
            new = stop, stop - width + 1 + length
            roll, where = Rolling(data, 1), begin[row]
            left = roll.of(where + np.minimum(new[0], old[0]), where + old[0])
            right = roll.of(where + old[1], where + np.maximum(new[1], old[1]))
            bucket = mix(mix(mix(bucket ^ left) + right) + number.astype(np.uint64))
            whole = mix(roll.of(where + first, where + last + length) ^ mix((stop - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
            rows = pa.array(row)
            cols = [batch.column("id").take(rows), pa.array(number.astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(unseen, pa.bool_())]
            places = batch.column("first").to_numpy()[row]
            cols += [pa.array((places + first).astype(np.int32)), pa.array((places + last + length).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "block", "bucket", "whole", "open", "first", "stop"])

    return run


def repeated_spans(docs: DataFrame, length: int = 200, q: int = 100) -> DataFrame:
    """(doc_id, mark, spans): stretches of bytes that repeated strings cover, not yet merged; mark is a hash of the text."""
    prepare(docs.sparkSession)
    if not 0 < q <= length or length < WIDTHS[0]:
        raise ValueError("q is from 1 to length, and length at least the widest block")
    scratch = Scratch(docs.sparkSession, "repeats")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    # 1: q-gram buckets of two runs or more; runs are cheap to compute, so they are made twice rather than kept
    runs = texts.mapInArrow(_runs(length, q), f"doc_id {kind}, mark long, bucket long, run long, first int, more int, lead int")
    buckets = runs.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = scratch.save(runs.join(buckets, "bucket", "left_semi"), "shared")
    # 2: of those, buckets whose runs are all equal, and equal runs in others
    alike = shared.groupBy("bucket").agg(F.min("run").alias("low"), F.max("run").alias("high")).where("low = high").select("bucket")
    mixed = scratch.save(shared.join(alike, "bucket", "left_anti"), "mixed")
    kinds = mixed.groupBy("bucket", "run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "first", "more", "lead")).alias("r"))
    kinds = scratch.save(kinds, "kinds")
    stop = (F.col("first") + F.col("more") + length).alias("stop")
    equal = mixed.join(kinds.where("n > 1").select("bucket", "run"), ["bucket", "run"], "left_semi").select("doc_id", "mark", "first", stop)
    whole = scratch.save(shared.join(alike, "bucket", "left_semi").select("doc_id", "mark", "first", stop).unionByName(equal), "whole")
    scratch.drop("shared")
    scratch.drop("mixed")
    # 3: one run of each kind goes on, as bytes; repeated rows of the table give the same snippets, which count once
    chosen = kinds.select("r.*", "bucket", (F.col("n") == 1).alias("open")).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "more", "lead", "open", "bucket")).alias("runs"))
    snippets = _met(texts, chosen, "inner").select("doc_id", "mark", "text", "runs")
    snippets = snippets.mapInArrow(_snippets(length), f"doc_id {kind}, mark long, first int, more int, lead int, open boolean, bucket long, snippet binary")
    snippets = scratch.save(snippets.withColumn("id", F.xxhash64("doc_id", "mark", "first")), "snippets")
    scratch.drop("kinds")
    start = F.array(F.struct(F.lit(0).alias("block"), "bucket", "open"))
    chosen, before, settled = None, 0, None
    for step, width in enumerate(WIDTHS):
        held = snippets.withColumn("blocks", start) if chosen is None else snippets.join(chosen, "id")
        blocks = held.mapInArrow(_refined(length, q, before, width), "id long, block int, bucket long, whole long, open boolean, first int, stop int")
        blocks = scratch.save(blocks, f"blocks{step}")
        spans, left = _sorted(scratch, blocks, step)
        settled = spans if settled is None else settled.unionByName(spans)
        chosen = left.groupBy("id").agg(F.collect_set(F.struct("block", "bucket", "open")).alias("blocks"))
        before = width
    places = snippets.select("id", "doc_id", "mark").dropDuplicates(["id"])
    single = settled.distinct().join(places, "id").select("doc_id", "mark", "first", "stop")
    spans = whole.unionByName(single).distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop("snippets")
    for step in range(len(WIDTHS)):
        scratch.drop(f"blocks{step}")
        scratch.drop(f"kinds{step}")
    scratch.drop("whole")
    return spans


def _sorted(scratch: Scratch, blocks: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Of one step's blocks: the spans (id, first, stop) that are settled as repeated, and the blocks that go on.

    ``open`` blocks are those whose windows are not known to be repeated; others are only there to be met.
    """
    kinds = blocks.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.max("open").alias("any"), F.min(F.struct("id", "block")).alias("r"))
    kinds = scratch.save(kinds, f"kinds{step}")
    twice = kinds.where("n > 1 and any").select("bucket", "whole")
    settled = blocks.where("open").join(twice, ["bucket", "whole"], "left_semi").select("id", "first", "stop")
    # buckets of several kinds, one of which has still to be decided
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1) & F.col("any")).alias("more")).where("kinds > 1 and more").select("bucket")
    left = kinds.join(mixed, "bucket", "left_semi").select("r.id", "r.block", "bucket", ((F.col("n") == 1) & F.col("any")).alias("open"))
    return settled, left


def _met(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.select(*[F.col(c).alias(f"o_{c}" if c in ("doc_id", "mark") else c) for c in other.columns])
    return texts.join(other, texts["mark"].eqNullSafe(other["o_mark"]) & texts["doc_id"].eqNullSafe(other["o_doc_id"]), how)


def remove(docs: DataFrame, length: int = 200, q: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of each document, as bytes, and what went."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, length, q)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))

    def run(batches):
        for batch in slices(batches, size=SLICE):
            out = []
            lists = batch.column("spans")
            size = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy()
            flat = lists.flatten()
            first, stop = flat.field("first").to_numpy(), flat.field("stop").to_numpy()
            ends = np.cumsum(size)
            for text, n, end in zip(batch.column("text").to_pylist(), size.tolist(), ends.tolist()):
                raw = text.encode("utf-8", "surrogatepass")
                if not n:
                    out.append((len(raw), 0, 0, raw))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, first[end - n : end], 1)
                np.add.at(edge, stop[end - n : end], -1)
                gone = np.cumsum(edge[:-1]) > 0
                count = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((len(raw), int(gone.sum()), count, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = _met(texts, spans, "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(left: DataFrame) -> DataFrame:
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """The same for a small list of texts, straight from the definition; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
