"""Predicates and request filters: projections by name, schedules, visibility, hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixwave.operators import pieces


def request(df: DataFrame, ids: list | None = None, equal: dict | None = None, fields: list[str] | None = None, between: tuple | None = None, order: list[str] | None = None, offset: int = 0, limit: int | None = None, key: str = "ID") -> DataFrame:
    """A request's filters in their order: ids, equalities, a closed range (column, low, high), fields, offset, then limit."""
    if ids is not None:
        df = df.where(F.col(key).isin(list(ids)))
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(v).cast(df.schema[c].dataType))
    if between:
        c, low, high = between
        df = df.where(F.col(c).between(low, high))
    if order or offset or limit is not None:
        df = df.orderBy(*(order or [key]))
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    if fields:
        df = df.select(*dict.fromkeys([*([key] if ids is not None else []), *fields]))
    return df


def relative_score(score: Column, theoretical: Column, threshold: float) -> Column:
    """score / theoretical >= threshold; without a theoretical score, no."""
    return F.coalesce(F.try_divide(score, theoretical) >= threshold, F.lit(False))


def on_schedule(schedule: Column, clock: Column) -> Column:
    """True if HH:mm lies in one of the ranges ``HH:mm-HH:mm|...`` (closed; a range past midnight wraps; equal ends are an error)."""

    def holds(r):
        ends = F.split(r, "-")
        a, b = F.lpad(F.trim(ends[0]), 5, "0"), F.lpad(F.trim(ends[1]), 5, "0")
        inside = F.when(a < b, clock.between(a, b)).otherwise((clock >= a) | (clock <= b))
        return F.when(a == b, F.raise_error(F.concat(F.lit("empty range "), r)).cast("boolean")).otherwise(inside)

    return F.exists(F.split(schedule, r"\|"), holds)


def visibility(projects: DataFrame, user: int, groups: list[int], viewers: DataFrame, collaborators: DataFrame) -> DataFrame:
    """Each project's one class for a user: owned, collaborate, view, public or none, in that priority."""
    member = lambda t, name: t.where(F.col("groupID").isin(groups)).select(F.col("projectID").alias("ID"), F.lit(True).alias(name)).distinct()
    rows = projects.join(member(collaborators, "__c"), "ID", "left").join(member(viewers, "__v"), "ID", "left")
    kind = F.when(F.col("ownerID") == user, "owned").when(F.col("__c"), "collaborate").when(F.col("__v"), "view").when(F.col("is_public"), "public").otherwise("none")
    return rows.withColumn("visibility", kind).drop("__c", "__v")


def hysteresis(df: DataFrame, by: list[str], at: list[str], value: str, off: float, on: float) -> DataFrame:
    """``powered``: false from a value below ``off`` until one above ``on``; null before either.

    The last known flag is a state that combines associatively, so each range of the order ``at`` has its own, which is carried
    over the ranges of a group; no task orders a group whole.
    """
    flag = F.when(F.col(value) < off, False).when(F.col(value) > on, True)
    rows = pieces.split(df.withColumn("__f", flag), at)
    known = F.when(F.col("__f").isNotNull(), F.struct(*at))
    last = rows.groupBy(*by, pieces.PIECE).agg(F.max_by("__f", known).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*by).orderBy(pieces.PIECE).rowsBetween(Window.unboundedPreceding, -1))
    within = F.last("__f", ignorenulls=True).over(Window.partitionBy(*by, pieces.PIECE).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))
    rows = pieces.met(rows, last.select(*by, pieces.PIECE, before.alias("__before")), by)
    return rows.withColumn("powered", F.coalesce(within, "__before")).drop("__f", "__before", pieces.PIECE)


def cold_folders(paths: DataFrame, path: str, now: str, minutes: int = 2) -> DataFrame:
    """Paths of minute folders (.../YYYY/MM/DD/HH/mm/...) that are at least some minutes old."""
    when = F.to_timestamp(F.regexp_extract(path, r"([0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}/[0-9]{2})", 1), "yyyy/MM/dd/HH/mm")
    return paths.where(when <= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
