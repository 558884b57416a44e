"""Phrase collocations: phrases of two to four words that occur together more often than their parts do apart.

Texts are cut into pieces, and equal pieces of a language become one with a multiplicity. Phrases are counted level by level, by
number of words. Each task numbers the words of a slice of pieces, adds up the weights of its phrases and sends what it has of
each hash bucket as one block; a task for each bucket streams these blocks through DuckDB, which groups them by the phrase itself
and goes to disk where memory doesn't suffice. Parts of a phrase are looked up by shuffled requests: a candidate sends one request
for each part of each cut to where the part's count is, and the answers come back to the candidate.

A phrase occurs no more often than any phrase within it. So from two words on a place is counted only where both phrases of one
word less that it holds may be frequent; a bit array of ``BITS`` bits tells (a hash of each frequent phrase sets one bit, so a
frequent phrase is never missed). Its size is fixed. On a corpus with so many frequent phrases that most bits are set, more
places are counted for nothing, and results stay the same.

Defined results: a null text is an empty one; a null lang is ``und``; repeated rows count as often as they are there; pieces
without words are left out; an empty table gives no rows; other columns are ignored, doc_id too.
"""

from __future__ import annotations

import string
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixwave.llm import vocabulary
from fixwave.llm.common import Scratch, lookup, prepare, slices
from fixwave.llm.rolling import Rolling, mix

STOPS = r"[.,;:!?\x0A-\x0D]"
BLANKS = b"\n \t"  # a newline is in no piece
SLICE = 4 << 20
BITS = 25
MEMORY = "256MB"
SPREAD = (1024, 32, 1)  # how many parts of a language are ranked apart, step by step
EXACT = "decimal(38,0)"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language that have words, and how often each occurs."""
    piece = F.btrim("piece", F.lit(" \t"))
    lowered = F.when(F.octet_length("piece") == F.length("piece"), F.lower("piece")).otherwise(F.translate("piece", string.ascii_uppercase, string.ascii_lowercase))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(F.coalesce("text", F.lit("")), STOPS, -1)).alias("piece"))
    rows = rows.withColumn("piece", piece).where("piece <> ''").withColumn("piece", lowered)
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _tag(langs: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) + 1 for x in langs], np.uint64))


def _summed(columns: list[np.ndarray], tops: list[int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct row of columns of small numbers, the place of its first row, and the sum of its weights."""
    code, top = columns[0], tops[0]
    for c, n in zip(columns[1:], tops[1:]):
        if top * n >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            top = len(code)
        code, top = code * n + c, top * n
    order = np.argsort(code, kind="stable")
    heads = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order[heads], np.add.reduceat(weight[order], heads) if len(heads) else np.empty(0, np.int64)


def _packed(keys: pa.Array, n: np.ndarray) -> bytes:
    """A block of phrases: their counts, lengths and bytes, compressed."""
    size = pc.binary_length(keys).to_numpy().astype("<i4")
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    body = keys.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if offsets[-1] > offsets[0] else b""
    return pa.compress(n.astype("<i8").tobytes() + size.tobytes() + body, codec="zstd", asbytes=True)


def _unpacked(n: int, size: int, block: pa.Buffer) -> pa.RecordBatch:
    raw = pa.decompress(block, decompressed_size=size, codec="zstd", asbytes=True)
    count, length = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i4", n, 8 * n)
    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    keys = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw[12 * n :]))
    return pa.RecordBatch.from_arrays([keys, pa.array(count)], names=["key", "n"])


def _blocks(size: int, buckets: int, known):
    """A mapInArrow function: from pieces, blocks of the phrases of ``size`` words (lang, newline, words), by bucket.

    With the words of size 1 goes the empty phrase, which occurs once for each word. ``known``: a broadcast bit array of what
    may be frequent at one word less.
    """

    def run(batches):
        for batch in slices(batches, "piece", SLICE):
            found = vocabulary.words([x.encode("utf-8", "surrogatepass") for x in batch.column("piece").to_pylist()], BLANKS)
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            lang = langs.indices.to_numpy().astype(np.int64)[found.owner]
            weight = batch.column("m").to_numpy()[found.owner]
            tag, rolling = _tag(names), Rolling(found.data)
            hashed = lambda at, k: mix(rolling.of(found.start[at], found.stop[at + k - 1]) ^ tag[lang[at]])
            at = np.arange(max(0, len(found.ids) - size + 1))
            at = at[found.owner[at] == found.owner[at + size - 1]]
            if size > 1:
                part = np.arange(len(found.ids) - size + 2)
                bits, inside = np.frombuffer(known.value, np.uint8), np.zeros(len(found.ids), bool)
                part = part[found.owner[part] == found.owner[part + size - 2]]
                where = hashed(part, size - 1) >> np.uint64(64 - BITS)
                inside[part] = (bits[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1
                at = at[inside[at] & inside[at + 1]]
            v = len(found.distinct)
            first, n = _summed([lang[at], *[found.ids[at + k] for k in range(size)]], [len(names), *[v] * size], weight[at])
            at = at[first]
            keys = langs.dictionary.cast(pa.large_binary()).take(pa.array(lang[at]))
            for k in range(size):
                keys = pc.binary_join_element_wise(keys, found.distinct.take(pa.array(found.ids[at + k])), pa.scalar(b" " if k else b"\n", pa.large_binary()))
            bucket = (hashed(at, size) % np.uint64(buckets)).astype(np.int64)
            if size == 1:
                one, total = _summed([lang], [len(names)], weight)
                keys = pa.concat_arrays([keys, pa.array([names[x].encode("utf-8", "surrogatepass") + b"\n" for x in lang[one].tolist()], pa.large_binary())])
                n, bucket = np.concatenate([n, total]), np.concatenate([bucket, (tag[lang[one]] % np.uint64(buckets)).astype(np.int64)])
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-2))
            keys, n = keys.take(pa.array(order)), n[order]
            rows = [(int(bucket[order[a]]), int(b - a), keys.slice(a, b - a), n[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            size_of = [12 * r[1] + int(pc.sum(pc.binary_length(r[2])).as_py() or 0) for r in rows]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(size_of, pa.int32()), pa.array([_packed(r[2], r[3]) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "n", "size", "block"])

    return run


def _counted(least: int):
    """A mapInArrow function: (key, a) of the phrases of a bucket's blocks that occur ``least`` times or more, by DuckDB."""

    def run(batches):
        import duckdb

        schema = pa.schema([("key", pa.large_string()), ("n", pa.int64())])

        def unpacked():
            for batch in batches:
                for n, size, block in zip(batch.column("n").to_pylist(), batch.column("size").to_pylist(), batch.column("block")):
                    yield _unpacked(n, size, block.as_buffer())

        with tempfile.TemporaryDirectory() as folder, duckdb.connect() as con:
            for setting in ("threads = 1", f"memory_limit = '{MEMORY}'", f"temp_directory = '{folder}'", "preserve_insertion_order = false"):
                con.execute(f"SET {setting}")
            con.register("blocks", pa.RecordBatchReader.from_batches(schema, unpacked()))
            found = con.sql(f"SELECT key, CAST(sum(n) AS BIGINT) AS a FROM blocks GROUP BY key HAVING sum(n) >= {int(least)}")
            for batch in found.to_arrow_reader(65536):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1)], names=["key", "a"])

    return run


def _bits(counts: DataFrame) -> bytes:
    """An array of 2 ** BITS bits in which each phrase of the table has set one."""

    def run(batches):
        for batch in batches:
            pairs = [k.rsplit("\n", 1) for k in batch.column("key").to_pylist()]
            pairs = [(a, b.encode("utf-8", "surrogatepass")) for a, b in pairs if b]
            data = np.frombuffer(b" ".join(b for _, b in pairs) + b" ", np.uint8)
            size = np.array([len(b) for _, b in pairs], np.int64)
            start = np.cumsum(size + 1) - size - 1
            h = mix(Rolling(data).of(start, start + size) ^ _tag([a for a, _ in pairs])) >> np.uint64(64 - BITS)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = counts.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.astype("<i8").tobytes()


def count(docs: DataFrame, longest: int = 4, least: int = 30) -> list[DataFrame]:
    """For each number of words up to ``longest``: (key, a) of the phrases that occur ``least`` times or more.

    The key is the language, a newline and the words; the first table also has the number of all words, under no words.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "phrases")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, known, levels = scratch.save(pieces(docs), "pieces"), None, []
    for size in range(1, longest + 1):
        blocks = rows.mapInArrow(_blocks(size, buckets, known), "bucket int, n int, size int, block binary")
        levels.append(scratch.save(blocks.repartition(buckets, "bucket").mapInArrow(_counted(least), "key string, a long"), f"level{size}"))
        known = spark.sparkContext.broadcast(_bits(levels[-1])) if size < longest else None
    scratch.drop("pieces")
    return levels


def _words(key: Column) -> Column:
    return F.split(F.substring_index(key, "\n", -1), " ")


def _part(key: Column, words: Column, start, size) -> Column:
    """The key of some of the words: the language and its newline come first."""
    head = F.left(key, F.length(key) - F.length(F.substring_index(key, "\n", -1)))
    return F.concat(head, F.array_join(F.slice(words, start, size), " "))


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (key, a) with l, r and score of their weakest cut; the parts' counts are looked up in ``counts``."""
    scratch = Scratch(candidates.sparkSession, "parts")
    w = candidates.select("key", "a", _words(F.col("key")).alias("w"))
    cut = w.select("key", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    ask = F.array(F.struct(F.lit("l").alias("side"), _part(F.col("key"), F.col("w"), 1, F.col("cut")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("key"), F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut")).alias("part")))
    requests = scratch.save(cut.select("key", "a", "cut", F.inline(ask)), "requests")
    found = lookup(requests, counts.select(F.col("key").alias("part"), F.col("a").alias("f")), "part")
    cuts = found.groupBy("key", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr(f"CAST(CAST(2000000 * CAST(a AS {EXACT}) AS {EXACT}) div (CAST(l AS {EXACT}) + CAST(r AS {EXACT})) AS BIGINT)")
    least = F.min(F.struct(score.alias("score"), F.col("cut").alias("cut"), F.col("l").alias("l"), F.col("r").alias("r")))
    return cuts.groupBy("key", "a").agg(least.alias("b")).select("key", "a", "b.l", "b.r", "b.score")


def whole(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer one explains: that holds their words and occurs at least four fifths as often.

    It is enough to look one word further, for what lies between a candidate and a longer one occurs as often as the longer one
    at least.
    """
    w = candidates.select("key", "a", _words(F.col("key")).alias("w")).where(F.size("w") > 2)
    inner = F.array(*[_part(F.col("key"), F.col("w"), k, F.size("w") - 1) for k in (1, 2)])
    inside = w.select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))
    rows = candidates.join(inside, "key", "left")
    return rows.where(F.expr(f"most IS NULL OR 100 * CAST(most AS {EXACT}) < 80 * CAST(a AS {EXACT})")).drop("most")


def mine(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score.

    They are ranked in parts of a language first, then what each part has kept together, so that no task sorts a language whole.
    """
    levels = count(docs, longest, least)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    candidates = counts.where(F.size(_words(F.col("key"))) > 1)
    rows = scored(whole(candidates), counts)
    rows = rows.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), F.substring_index("key", "\n", -1).alias("phrase"), "a", "l", "r", "score")
    for parts in SPREAD:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        rows = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    totals = levels[0].where(F.endswith("key", F.lit("\n"))).select(F.expr("left(key, length(key) - 1)").alias("lang"), F.col("a").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), numbered AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), words AS (
  SELECT id, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered
), places AS (
  SELECT lang, w1, lead(w1, 1) OVER f AS w2, lead(w1, 2) OVER f AS w3, lead(w1, 3) OVER f AS w4 FROM words WINDOW f AS (PARTITION BY id ORDER BY i)
), counts AS MATERIALIZED (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM places GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM places WHERE w4 IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 30
), inner_phrases AS (
  SELECT d.lang, array_to_string(list_slice(d.w, i, i + s - 1), ' ') AS phrase, max(d.a) AS most
  FROM candidates d, (SELECT unnest([1, 2, 3]) AS i) starts, (SELECT unnest([2, 3]) AS s) sizes
  WHERE s < d.size AND i + s - 1 <= d.size GROUP BY ALL
), asked AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS lp, array_to_string(list_slice(w, k + 1, size), ' ') AS rp
  FROM candidates, (SELECT unnest([1, 2, 3]) AS k) ks WHERE k < size
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM asked c JOIN counts l ON l.lang = c.lang AND l.phrase = c.lp JOIN counts r ON r.lang = c.lang AND r.phrase = c.rp
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN inner_phrases i ON w.lang = i.lang AND w.phrase = i.phrase
  WHERE i.most IS NULL OR 100 * i.most::HUGEINT < 80 * w.a::HUGEINT
)
SELECT r.lang, r.rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""
