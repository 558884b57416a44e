"""Sequence operators over time: sessions, intervals, windows by rows, and neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixwave.operators import pieces
from fixwave.operators.joins import small


def best_per_time(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Of rows of one group and time, the one of the greatest value; the least ``tie`` among equals."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def sessions(df: DataFrame, by: list[str], at: str, margin) -> DataFrame:
    """(first, last, n) of runs of rows; a gap of twice the margin, or more, begins a new run. Runs are widened by the margin."""
    rows = pieces.previous(pieces.split(df.select(*by, at), [*by, at]), by, [at], [at], "__before")
    new = F.coalesce((F.col(at) - F.col(f"__before.{at}") >= 2 * margin).cast("int"), F.lit(1))
    rows = pieces.running_sum(rows.withColumn("__new", new).drop("__before"), by, [at], "__new", "session")
    runs = rows.groupBy(*by, "session").agg((F.min(at) - margin).alias("first"), (F.max(at) + margin).alias("last"), F.count("*").alias("n"))
    return runs


def tumbling(at: Column, width: int) -> Column:
    """The start of the interval, a multiple of ``width``, that holds ``at``."""
    return (F.floor(at / width) * width).cast("long")


def augmented(df: DataFrame, at: str, width: int, context: int) -> DataFrame:
    """Each row for every tumbling interval that it is in or within ``context`` of (at most two sides), with ``core`` true in its own."""
    start = tumbling(F.col(at), width)
    offset = F.col(at) - start
    starts = F.array_compact(F.array(F.when(offset < context, start - width), start, F.when(offset >= width - context, start + width)))
    return df.withColumn("interval", F.explode(starts)).withColumn("core", tumbling(F.col(at), width) == F.col("interval"))


def last_n(df: DataFrame, by: list[str], at: str, n: int, tie: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def row_windows(df: DataFrame, by: list[str], at: str, size: int, overlap: int, tie: str) -> DataFrame:
    """Each row for every window of ``size`` rows in time order that holds it; neighbours share ``overlap`` rows or more.

    Windows begin at multiples of size - overlap; the last begins early enough to be full, so it may share more.
    """
    step = size - overlap
    total = df.groupBy(*by).agg(F.count("*").alias("__m"))
    rows = pieces.numbered(df, by, [*by, at, tie]).drop(pieces.PIECE)
    rows = rows.join(small(total), by)
    final = F.greatest(F.lit(0), F.ceil((F.col("__m") - size) / step))
    low = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / step))
    high = F.least(F.floor(F.col("__i") / step), final)
    ids = F.when(high >= low, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<bigint>"))
    begins = F.greatest(F.col("__m") - size, F.lit(0))  # where the last window begins
    ids = F.when((F.col("__i") >= begins) & ~F.array_contains(ids, final), F.concat(ids, F.array(final))).otherwise(ids)
    return rows.withColumn("window_id", F.explode(ids)).drop("__i", "__m")


def movement(df: DataFrame, by: list[str], at: str, x: str, y: str, tie: str) -> DataFrame:
    """Speed since the last point, and acceleration between the middles of neighbouring legs."""
    order = [at, tie]
    rows = pieces.previous(pieces.split(df, [*by, *order]), by, order, [at, x, y], "__a")
    dt = F.col(at) - F.col(f"__a.{at}")
    step = F.hypot(F.col(x) - F.col(f"__a.{x}"), F.col(y) - F.col(f"__a.{y}"))
    rows = rows.withColumn("speed", F.try_divide(step, dt)).withColumn("__mid", F.col(at) - dt / 2).drop("__a")
    rows = pieces.previous(rows, by, order, ["speed", "__mid"], "__b")
    change = F.try_divide(F.col("speed") - F.col("__b.speed"), F.col("__mid") - F.col("__b.__mid"))
    return rows.withColumn("acceleration", change).drop("__mid", "__b", pieces.PIECE)


def ends(df: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """The first and the last value of each column in time."""
    return df.groupBy(*by).agg(*[f(v, at).alias(f"{n}_{v}") for v in values for n, f in (("first", F.min_by), ("last", F.max_by))])


def id_gaps(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """How many ids are missing between the least and the greatest: the sum of steps less one, by extremes alone."""
    return df.groupBy(*by).agg((F.max(key) - F.min(key) + 1 - F.count_distinct(key)).alias("missing"))


def ahead(df: DataFrame, by: list[str], at: str, seconds) -> DataFrame:
    """For each row, how many rows of its group come within ``seconds`` after it (itself included); of a null time, its like.

    Rows are counted by time first. In a bucket of that width, what lies ahead of a time is the bucket without the times before
    it, and the next bucket up to the same offset: two running sums, not a frame that is read again for every row.
    """
    width = F.lit(seconds)
    times = df.groupBy(*by, F.col(at).alias("__t")).agg(F.count("*").alias("__n"))
    bucket = F.floor(F.col("__t") / width)
    # A time lies in its bucket as one that waits for its count, and ends the counts of times of the bucket before.
    both = times.withColumn("__at", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket - 1).alias("b"), F.lit(False).alias("own")))))
    both = both.select(*by, "__t", "__n", F.col("__at.b").alias("__b"), F.col("__at.own").alias("__own"))
    own, after = F.when(F.col("__own"), F.col("__n")).otherwise(0), F.when(F.col("__own"), 0).otherwise(F.col("__n"))
    place = F.when(F.col("__own"), F.col("__t") + width).otherwise(F.col("__t"))  # where the frame of a time ends
    group = Window.partitionBy(*by, "__b")
    upto = group.orderBy("__place").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__place", place).withColumn("n_ahead", F.sum(own).over(group) - F.sum(own).over(upto) + F.col("__n") + F.sum(after).over(upto))
    found = both.where("__own").select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__t").alias("__of"), F.when(F.col("__t").isNull(), F.col("__n")).otherwise(F.col("n_ahead")).alias("n_ahead"))
    cond = F.col(at).eqNullSafe(F.col("__of"))
    for k, c in enumerate(by):
        cond = F.col(c).eqNullSafe(F.col(f"__by{k}")) & cond
    return df.join(found, cond).drop("__of", *[f"__by{k}" for k in range(len(by))])


def shifted(start: float, end: float, by: int) -> tuple[float, float]:
    """A time range moved by its own width, ``by`` times."""
    return start + by * (end - start), end + by * (end - start)


def resolved(start: float | None = None, end: float | None = None, width: float | None = None) -> tuple[float, float]:
    """Start and end from any two of start, end and width."""
    if start is not None and end is not None:
        return start, end
    if width is None or (start is None and end is None):
        raise ValueError("two of start, end and width are needed")
    return (start, start + width) if start is not None else (end - width, end)
