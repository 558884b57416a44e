"""Order without one task for each group: rows are dealt into ranges of a key, and what crosses a range's edge is carried.

The bounds of ranges come from a random sample of keys that is taken once, when the plan is built (SAMPLE keys for each range,
which no result hangs on), and are then fixed: the range of a row is a function of its key, however often, and in however many
branches of a plan, it is computed. Rows of equal keys share a range; so a group is split as finely as its keys differ.

There are as many ranges as shuffle partitions, which are set by the size of the input; no number is the most. The bounds are one
constant of the plan, and a key's range is found in it by halving: a comparison in generated code for each power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 32
PIECE = "__piece"


def split(df: DataFrame, order: list[str], pieces: int | None = None) -> DataFrame:
    """``df`` with ``__piece``, the number of the range that holds its (order) key: as many ranges as shuffle partitions.

    Null keys come first and NaN last, as in Spark's ascending order.
    """
    spark = df.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = sorted(df.select(*order, F.rand(0).alias("__r")).orderBy("__r").limit(max(8192, SAMPLE * pieces)).drop("__r").collect(), key=lambda r: [(v is not None, v != v, v) for v in r])
    bounds = list(dict.fromkeys(tuple(keys[len(keys) * k // pieces]) for k in range(1, pieces))) if keys else []
    if not bounds:
        return df.withColumn(PIECE, F.lit(0))
    kinds = {c: df.schema[c].dataType for c in order}
    bound = lambda k: F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(k, kinds.items())])
    key, table = F.struct(*order), F.array(*map(bound, bounds))  # an array of constants, folded to one
    rows = df.withColumn(PIECE, F.lit(0))
    for step in (1 << k for k in reversed(range(len(bounds).bit_length()))):  # past the last bound is null, which is not below
        rows = rows.withColumn(PIECE, F.col(PIECE) + F.when(F.get(table, F.col(PIECE) + F.lit(step - 1)) < key, step).otherwise(0))
    return rows


def _carried(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Rows with ``name``: an aggregate of each piece, as the window function ``value`` carries it over the group's pieces."""
    return rows.select(*by, PIECE, value.alias(name))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "__i") -> DataFrame:
    """Row numbers from 0 of each group in the stated order, and ``__piece``: counts of pieces are summed up, then numbers added."""
    rows = split(df, order)
    sizes = rows.groupBy(*by, PIECE).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy(*by, PIECE).orderBy(*order)) - 1
    return met(rows, _carried(sizes, by, before, "__before"), by).withColumn(name, F.col("__before") + number).drop("__before")


def met(rows: DataFrame, of: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns that ``of`` has of their group and piece; a null in ``by`` is a group like others."""
    on = [*by, PIECE]
    of = of.select(*[F.col(c).alias(f"__on{k}") for k, c in enumerate(on)], *[c for c in of.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"__on{k}")) for k, c in enumerate(on)]
    return rows.join(of, cond).drop(*[f"__on{k}" for k in range(len(on))])


def previous(rows: DataFrame, by: list[str], order: list[str], values: list[str], name: str) -> DataFrame:
    """Rows (of ``split``) with ``name``: a struct of the last row's values in the group's order, null for the first row."""
    own = F.struct(*values)
    last = rows.groupBy(*by, PIECE).agg(F.max_by(own, F.struct(*order)).alias("__last"))
    edge = _carried(last, by, F.lag("__last").over(Window.partitionBy(*by).orderBy(PIECE)), "__edge")
    within = F.lag(own).over(Window.partitionBy(*by, PIECE).orderBy(*order))
    return met(rows, edge, by).withColumn(name, F.coalesce(within, "__edge")).drop("__edge")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Rows (of ``split``) with the sum of ``value`` up to the row, rows of equal keys included."""
    total = rows.groupBy(*by, PIECE).agg(F.sum(value).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(value).over(Window.partitionBy(*by, PIECE).orderBy(*order).rangeBetween(Window.unboundedPreceding, 0))
    return met(rows, _carried(total, by, before, "__before"), by).withColumn(name, F.col("__before") + within).drop("__before")


def around(rows: DataFrame, by: list[str], at: str, value: str, before: str, after: str) -> DataFrame:
    """Rows (of ``split``) with the last ``value`` that isn't null at or before the row's time, and the first at or after it.

    The latter is the last one of the reversed order: a growing frame takes each row once.
    """
    when = F.when(F.col(value).isNotNull(), F.col(at))
    edge = rows.groupBy(*by, PIECE).agg(F.max_by(value, when).alias("__l"), F.min_by(value, when).alias("__f"))
    beyond = lambda v, sort: F.last(v, ignorenulls=True).over(Window.partitionBy(*by).orderBy(sort(PIECE)).rowsBetween(Window.unboundedPreceding, -1))
    within = lambda sort: F.last(value, ignorenulls=True).over(Window.partitionBy(*by, PIECE).orderBy(sort(at)).rangeBetween(Window.unboundedPreceding, 0))
    rows = met(rows, edge.select(*by, PIECE, beyond("__l", F.asc).alias("__far_a"), beyond("__f", F.desc).alias("__far_b")), by)
    return rows.withColumns({before: F.coalesce(within(F.asc), "__far_a"), after: F.coalesce(within(F.desc), "__far_b")}).drop("__far_a", "__far_b")
