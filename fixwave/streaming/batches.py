"""Incremental processing: watermarked windows and sessions, guarded cursors, and idempotent batch replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Counts and sums of value per tumbling window; rows later than ``late`` are left out, as in the fetch guard."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), *by)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def session_counts(events: DataFrame, at: str, by: list[str], gap: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by)
    return s.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def settled(df: DataFrame, at: str, now: float, seconds: float = 120) -> DataFrame:
    """Only what is at least ``seconds`` old."""
    return df.where(F.col(at) <= now - seconds)


def cursor_of(cursors: DataFrame, name: str, bound: str | None = None) -> int:
    """A cursor's value (0 if there is none), never past the cursor named ``bound``."""
    row = cursors.where(F.col("name").isin([name, bound or name])).groupBy().pivot("name", [name, *([bound] if bound and bound != name else [])]).agg(F.max("value")).first()
    mine = (row and row[name]) or 0
    return min(mine, row[bound] or 0) if bound else mine


def next_batch(df: DataFrame, key: str, last: int, limit: int, until: int | None = None) -> DataFrame:
    """The next ``limit`` rows by id past a cursor, at most up to ``until``: a keyset page."""
    rows = df.where(F.col(key) > last)
    if until is not None:
        rows = rows.where(F.col(key) <= until)
    return rows.orderBy(key).limit(limit)


def process(stream: DataFrame, step: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``step`` on every micro-batch and hand its result to an idempotent sink (an upsert or a range replacement).

    A batch that failed is run again with the same rows and number, so its result replaces what it had left.
    """

    def one(batch: DataFrame, number: int) -> None:
        out = step(batch).persist()
        sink(out, number)
        out.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def statistics(process: str, start: float, seconds: float, batch: DataFrame, key: str, n_out: int) -> DataFrame:
    """A row for the processing statistics: ids covered, rows in and out."""
    return batch.agg(F.lit(process).alias("process"), F.lit(start).alias("start_time"), F.lit(seconds).alias("duration"), F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count("*").alias("num_input"), F.lit(n_out).cast("long").alias("num_output"))
