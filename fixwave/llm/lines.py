"""Line dedup: lines that many documents share are dropped everywhere but in the document with the largest doc_id.

Everything on the main path is DataFrame functions. Lines are normalised and exploded, each is known by two 64-bit hashes, and
the distinct doc_ids that hold a hash are counted (dealt by hash and doc_id first, so that no hash is one task's work). Lines over the threshold are joined
back to their places, places are gathered by row, and each text is put together from the lines that are left, by position. Only
hashes and places are shuffled for the count and the join; texts are shuffled once, to meet the places that they lose.

A line that a third of all rows hold is counted from partial sums and met by a broadcast: a key counts as hot where it has more
than a ``HOT``-th of all rows of shared keys, so there are ``HOT`` of them at most, whatever the input.

Defined results: a null or empty text is one empty line; repeated rows and rows of one doc_id count
as one document, and all rows of the largest doc_id keep their lines; a null doc_id is one more document, smaller than any other; an empty table
gives no rows; a text that loses all its lines is empty; other columns are ignored by ``remove`` and kept by ``clean``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixwave.llm.common import Scratch, let

BLANK = " \t\n\x0b\x0c\r"
HOT = 20_000
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, and with A-Z in lower case. Lines of ASCII take the quicker of two equal ways."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def shared(texts: DataFrame, documents: int, length: int) -> DataFrame:
    """(h1, h2, n, keep): keys that ``documents`` doc_ids or more hold, how many rows do, and the largest of these doc_ids."""
    keys = F.array_distinct(F.filter(F.transform(_lines(texts["text"]), line_key), lambda k: F.length(k) >= length))
    rows = texts.select("doc_id", F.explode(keys).alias("key")).select("doc_id", *_hashed(F.col("key")))
    return rows.groupBy(*KEY).agg(F.count_distinct(F.struct("doc_id")).alias("ids"), F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("ids") >= documents).drop("ids")


def places(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, at, h1, h2): each line that is long enough, by the row that holds it and its place there."""
    rows = texts.select("doc_id", "mark", F.posexplode(_lines(texts["text"])).alias("at", "line")).withColumn("line", line_key(F.col("line")))
    return rows.where(F.length("line") >= length).select("doc_id", "mark", "at", *_hashed(F.col("line")))


def remove(docs: DataFrame, documents: int = 3, length: int = 20) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row: keys of ``length`` code points in ``documents`` rows lose their lines."""
    texts = _marked(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return _dropped(texts, documents, length).select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), _kept().alias("kept"))


def clean(docs: DataFrame, documents: int = 3, length: int = 20) -> DataFrame:
    """The same rows and columns, with the lines dropped from the text, and n_chars, if any, counted anew."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    texts = _marked(rows.select("d", F.col("d.doc_id").alias("doc_id"), F.coalesce("d.text", F.lit("")).alias("text")))
    out = _dropped(texts, documents, length).withColumn("__t", F.when(F.col("lost").isNull(), F.col("d.text")).otherwise(_kept()))
    return out.select(*[F.col("__t").alias(c) if c == "text" else F.length("__t").cast("long").alias(c) if c == "n_chars" else F.col("d").getField(c).alias(c) for c in docs.columns])


def _marked(texts: DataFrame) -> DataFrame:
    """Rows are known by doc_id and a hash of the text; rows that agree in both have the same lines, and lose the same."""
    return texts.withColumn("mark", F.xxhash64("text"))


def _dropped(texts: DataFrame, documents: int, length: int) -> DataFrame:
    """The rows with ``lost``: the places of the lines that they lose, or null."""
    scratch = Scratch(texts.sparkSession, "lines")
    keys = scratch.save(shared(texts, documents, length), "shared")
    lines = scratch.save(places(texts, length), "places")
    limit = (keys.agg(F.sum("n")).first()[0] or 0) / HOT
    hot, rest = F.broadcast(keys.where(F.col("n") > limit)), keys.where(F.col("n") <= limit)
    met = lines.join(hot, KEY).unionByName(lines.join(hot.select(*KEY), KEY, "left_anti").join(rest, KEY))
    lost = met.where(~F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("lost"))
    lost = lost.select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), "lost")
    return texts.join(lost, texts["doc_id"].eqNullSafe(lost["__d"]) & (texts["mark"] == lost["__m"]), "left").drop("__d", "__m")


def _kept() -> Column:
    """What is left of ``text`` without the lines at the places ``lost``, in time that grows with the number of lines."""

    def joined(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
        return F.array_join(F.transform(left, lambda k: F.element_at(lines, k + 1)), "\n")

    return F.when(F.col("lost").isNull(), F.col("text")).otherwise(let(_lines(F.col("text")), joined))


def digest(rows: DataFrame) -> DataFrame:
    """Counts, and a hash of the text that is left."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keep AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
