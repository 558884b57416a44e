"""Aggregates of dashboards, histograms, spectra and resampled tracks."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixwave.operators.joins import copies, near, near_pairs, small
from fixwave.session import shared


def averages(df: DataFrame, by: list[str], columns: list[str], places: int = 3) -> DataFrame:
    return df.groupBy(*by).agg(*[F.round(F.avg(c), places).alias(f"avg_{c}") for c in columns])


def rate(total: Column, duration: Column) -> Column:
    return F.try_divide(F.sum(total), F.sum(duration))


def backlog(df: DataFrame, key: str, cursor: DataFrame, name: str) -> DataFrame:
    """How far the greatest id is ahead of a named cursor (from zero, if there is none)."""
    at = cursor.where(F.col("name") == name).agg(F.coalesce(F.max("value"), F.lit(0).cast("long")).alias("at"))
    return df.agg(F.max(key).alias("top")).crossJoin(F.broadcast(at)).select(F.lit(name).alias("name"), "top", "at", (F.coalesce("top", F.lit(0).cast("long")) - F.col("at")).alias("backlog"))


def equal_bins(df: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """(bin, low, high, n, bins) of a histogram of 1 + (max - min) div width equal bins over [min, max], the last closed."""
    bounds = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    bounds = bounds.withColumn("bins", (1 + F.floor((F.col("high") - F.col("low")) / width)).cast("long"))
    rows = df.select(*by, value).join(bounds, by)
    share = F.coalesce(F.try_divide((F.col(value) - F.col("low")) * F.col("bins"), F.col("high") - F.col("low")), F.lit(0.0))
    rows = rows.withColumn("bin", F.least(F.floor(share), F.col("bins") - 1))
    return rows.groupBy(*by, "bin", "low", "high", "bins").agg(F.count("*").alias("n"))


def mode_and_moment(hist: DataFrame, by: list[str], weight: float = 0.02) -> DataFrame:
    """The middle of the first fullest bin (rounded down), and the second moment about it over all bins but the last."""
    width = (F.col("high") - F.col("low")) / F.col("bins")
    mid = F.floor(F.col("low") + (F.col("bin") + 0.5) * width)
    w = Window.partitionBy(*by)
    rows = hist.withColumn("mid", mid).withColumn("most", F.max("n").over(w)).withColumn("mode", F.max_by("mid", F.struct("n", -F.col("bin"))).over(w))
    gap = F.col("mid") - F.col("mode")
    term = F.when(F.col("bin") < F.col("bins") - 1, weight * F.col("n") / F.col("most") * gap * gap).otherwise(0.0)
    return rows.groupBy(*by).agg(F.first("mode").alias("mode"), F.sum(term).alias("moment"), F.sum("n").alias("n"))


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin numbers from 0; the upper end belongs to the last bin, what is outside to none."""
    return F.when(value == high, F.lit(bins - 1)).when((value >= low) & (value < high), F.floor((value - low) / (high - low) * bins)).cast("int")


def density_histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n, density): counts over equal bins of [low, high], and their share of what lies there by unit of the value."""
    rows = df.select(*by, bin_of(F.col(value), low, high, bins).alias("bin")).where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return rows.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*by)) / ((high - low) / bins))  # ``bins`` rows of a group at most


def activity(p: Column) -> Column:
    """The spread of a spectrum: root of the summed squared deviations, over the sum."""
    return F.try_divide(F.sqrt(F.var_pop(p) * F.count(p)), F.sum(p))


def vector_sum(df: DataFrame, by: list[str], vector: str, out: str, mean: bool = False) -> DataFrame:
    """Element-wise sum (or mean) of arrays, aggregated by element before anything is gathered; sums are of fixed length."""
    rows = df.select(*by, F.posexplode(vector).alias("__i", "__v")).groupBy(*by, "__i").agg((F.avg if mean else F.sum)("__v").alias("__v"))
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__i", "__v"))).alias(out))
    return packed.withColumn(out, F.transform(out, lambda s: s["__v"]))


def argmax(vector: Column) -> Column:
    """The first index, from 0, of the greatest element."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def order_statistic(df: DataFrame, by: list[str], value: str, level: float, out: str, bins: int = 1024, few: int = 10_000) -> DataFrame:
    """(by, out): the element at int(n * level) of each group's values in order; nulls don't count, NaN comes last.

    Found by selection: the values between a group's bounds are counted in ``bins`` bins, and the bin that holds the place gives
    the next bounds, until ``few`` values or fewer, or equal ones, lie between them. Only these are put in order, so no group is.
    Bins are by turns even in the logarithm and in the value, so that any spread is narrowed in about a dozen rounds at most.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("__v"))
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    state = state.withColumn("place", F.least(F.floor(F.col("n") * level), F.col("n") - 1))
    low, high, x, far = F.col("low").cast("double"), F.col("high").cast("double"), F.col("__v").cast("double"), F.lit(1.7e308)
    open_ = (F.col("n") > few) & (low != high)
    for turn in itertools.count():
        state = _written(state)
        if state.where(open_).isEmpty():
            break
        a, b = F.greatest(low, -far), F.when(F.isnan(high), far).otherwise(F.least(high, far))
        # halves keep the difference of far bounds finite; a bin is monotone in the value, whatever is rounded
        even = _octaves if turn % 2 == 0 else (lambda v: v / 2)
        share = F.coalesce(F.try_divide(even(x) - even(a), even(b) - even(a)), F.lit(0.0))
        place = F.when(F.isnan(x), bins + 1).when(x == float("inf"), bins).when(x == float("-inf"), -1).otherwise(F.greatest(F.lit(0), F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int"))
        met = _between(rows, state.where(open_), keys).withColumn("bin", place)
        counts = met.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.max("place").alias("place"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))  # bins + 3 rows of a group at most
        own = counts.withColumn("upto", upto).where("upto > place AND upto - n <= place").withColumn("place", F.expr("place - upto + n"))
        state = state.where(~open_).unionByName(own.select(*state.columns))
    counts = _between(rows, state, keys).groupBy(*keys, "__v").agg(F.count("*").alias("n"), F.max("place").alias("place"))
    found = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("__v"))).where("upto > place AND upto - n <= place")
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("__v").alias(out))


def _octaves(v: Column) -> Column:
    """The logarithm of a finite number, with its sign; it grows with the number from the least to the greatest, 0 included."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _written(state: DataFrame) -> DataFrame:
    """A table of one row for each group, cut off by the shared folder from what it was made from."""
    path, schema = shared(state.sparkSession, "selection"), state.schema
    state.write.parquet(path)
    return state.sparkSession.read.schema(schema).parquet(path)


def _between(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie between their group's bounds, with its place; a null is a key like others. Few groups are broadcast."""
    of = state.select(*[F.col(k).alias(f"__of{k}") for k in keys], "low", "high", "place")
    cond = F.col("__v").between(F.col("low"), F.col("high"))
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"__of{k}")) & cond
    return rows.join(small(of), cond).drop(*[f"__of{k}" for k in keys])


def gram_matrix(re: list[Column], im: list[Column]) -> list[Column]:
    """Sums of x_a conj(x_b) over rows, real and imaginary parts row by row."""
    out = []
    for a in range(len(re)):
        for b in range(len(re)):
            out.append(F.sum(re[a] * re[b] + im[a] * im[b]).alias(f"g{a + 1}{b + 1}r"))
            out.append(F.sum(im[a] * re[b] - re[a] * im[b]).alias(f"g{a + 1}{b + 1}i"))
    return out


def density(df: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """5 + 2 for every other point within the radius.

    Where points of one place are usual, places are met and their points only counted, as no key is there twice.
    """
    found = copies(df, [x, y])
    if found is None or not df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        n, on = near_pairs(df, key, x, y, radius).groupBy(F.col("k_1").alias(key)).count(), [key]
    else:
        n = near(found[0], "__n", x, y, radius).groupBy(F.col("x_1").alias(x), F.col("y_1").alias(y)).agg((F.sum("__n_2") - 1).alias("count"))
        n, on = small(n), [x, y]
    return df.join(n, on, "left").select(*df.columns, "count").withColumn("density", 5 + 2 * F.coalesce("count", F.lit(0))).drop("count")


def mean_resample(df: DataFrame, by: list[str], at: str, values: list[str], bins: int = 100, longest: float = 3600.0) -> DataFrame:
    """Means over equal intervals of each group's time range, closed on both sides (a point on an edge is in both).

    There are ``bins`` equal intervals; where these would be longer than ``longest``, intervals are of just that length, and as
    many as reach the end of the range.
    """
    bounds = df.groupBy(*by).agg(F.min(at).alias("__a"), F.max(at).alias("__z"))
    rows = df.join(bounds, by)
    span = F.col("__z") - F.col("__a")
    width, count = span / F.lit(float(bins)), F.lit(bins).cast("long")
    if longest:
        count = F.when(width > longest, F.ceil(span / longest)).otherwise(count)
        width = F.least(width, F.lit(longest))
    rows = rows.withColumn("__w", width).withColumn("__k", count)
    place = F.coalesce(F.try_divide(F.col(at) - F.col("__a"), F.col("__w")), F.lit(0.0))
    edge = place == F.floor(place)
    which = F.array_compact(F.array(F.when(edge & (place > 0), F.floor(place) - 1), F.when(place < F.col("__k"), F.floor(place))))
    out = rows.withColumn("bin", F.explode(which))
    return out.groupBy(*by, "bin").agg(F.avg(at).alias(f"mean_{at}"), *[F.avg(v).alias(f"mean_{v}") for v in values], F.count("*").alias("n"))


def score_breakdown(score: Column, theoretical: Column) -> list[Column]:
    return [
        F.count_if(score.isNull()).alias("unscored"), F.count_if(theoretical == 0).alias("no_interval"), F.count_if(score < 0).alias("bad"),
        F.count_if(score == 0).alias("zero"), F.count_if(score > 0).alias("positive"),
    ]
