"""Elevation and line of sight over a raster table (row, col, elevation), as joins on cells.

A ray is not sampled whole. ``pyramid`` has the greatest elevation of tiles of 2, 4, 8 ... cells a side. The samples of a ray are
taken in blocks of a power of eight; a block lies in four tiles at most, and if none of these is high enough to hide the point,
seen from the block's near or far end, the block is done. Only the others are cut into eight, down to single samples, which are
tested exactly. So what a point costs is set by the ridges near its line, not by its distance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.functions.geo import elevation_angle, raster_index
from fixwave.operators.joins import small
from fixwave.session import shared


CUT = 8  # how many parts a block is cut into


@dataclass(frozen=True)
class Raster:
    """Where a raster lies: the centre of its first cell, the steps of columns and rows (rows go south), and its size."""

    east: float
    north: float
    step: float
    rows: int
    cols: int

    def cell(self, east, north):
        return raster_index(-north, -self.north, self.step, self.rows), raster_index(east, self.east, self.step, self.cols)


def elevated(points: DataFrame, raster: DataFrame, where: Raster, east: str = "easting", north: str = "northing", out: str = "elevation") -> DataFrame:
    """Each point with the elevation of its nearest cell; points beyond the edge take the cell at the edge."""
    row, col = where.cell(F.col(east), F.col(north))
    cells = raster.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("elevation").alias(out))
    return points.withColumn("__r", row).withColumn("__c", col).join(cells, ["__r", "__c"], "left").drop("__r", "__c")


def pyramid(raster: DataFrame, where: Raster) -> DataFrame:
    """(level, row, col, top): the greatest elevation of each tile of 2 ** level cells a side, up to one tile."""
    level = raster.groupBy("row", "col").agg(F.max("elevation").alias("top"))
    out = level.select(F.lit(0).alias("level"), "row", "col", "top")
    for k in range(1, max(where.rows, where.cols, 1).bit_length() + 1):
        level = level.groupBy(F.shiftright("row", 1).alias("row"), F.shiftright("col", 1).alias("col")).agg(F.max("top").alias("top"))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "row", "col", "top"))
    return out


def line_of_sight(points: DataFrame, key: str, raster: DataFrame, where: Raster, site: tuple[float, float, float], step: float = 10.0, tiles: DataFrame | None = None) -> DataFrame:
    """(key, distance, angle, visible): from a site (easting, northing, elevation) to points with easting, northing, elevation.

    The straight line is sampled every ``step`` metres; a sample whose angle from the site is greater than the point's hides it.
    Samples whose cell the raster lacks hide nothing. ``tiles``: the raster's ``pyramid``, if it is there already.
    """
    e0, n0, z0 = site
    if tiles is None:  # each step reads them: written once
        pyramid(raster, where).write.parquet(path := shared(raster.sparkSession, "tiles"))
        tiles = raster.sparkSession.read.parquet(path)
    tiles = small(tiles)
    de, dn = F.col("easting") - e0, F.col("northing") - n0
    rays = points.select(key, de.alias("__e"), dn.alias("__n"), F.hypot(de, dn).alias("__d"), F.col("elevation"))
    rays = rays.withColumn("__a", elevation_angle(F.col("elevation") - z0, F.col("__d"))).drop("elevation")
    last = F.ceil(F.col("__d") / step).cast("int") - 1

    def cell(sample):
        share = F.try_divide(sample * F.lit(step), F.col("__d"))
        return where.cell(e0 + F.col("__e") * share, n0 + F.col("__n") * share)

    size = CUT
    while size < max(where.rows, where.cols) * where.step / step:
        size *= CUT
    first = F.explode(F.sequence(F.lit(0), F.floor((F.col("__to") - 1) / size).cast("int")))
    open_ = rays.withColumn("__to", last).where("__to >= 1").withColumn("__b", first)
    open_ = open_.withColumn("__from", F.col("__b") * size + 1).withColumn("__to", F.least(F.col("__to"), (F.col("__b") + 1) * size)).drop("__b")
    while size > 1:
        size //= CUT
        (r1, c1), (r2, c2) = cell(F.col("__from")), cell(F.col("__to"))
        boxed = open_.withColumns({"__r1": F.least(r1, r2), "__r2": F.greatest(r1, r2), "__c1": F.least(c1, c2), "__c2": F.greatest(c1, c2)})
        span = F.greatest(F.col("__r2") - F.col("__r1"), F.col("__c2") - F.col("__c1"))
        boxed = boxed.withColumn("level", F.when(span > 0, F.ceil(F.log2(span + 1.0)).cast("int")).otherwise(0))
        shift = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
        corners = F.array_distinct(F.array(*[F.struct(shift(r).alias("row"), shift(c).alias("col")) for r in ("__r1", "__r2") for c in ("__c1", "__c2")]))
        near = boxed.select(key, "__from", "__to", "level", F.explode(corners).alias("t")).select(key, "__from", "__to", "level", "t.*")
        tops = near.join(tiles, ["level", "row", "col"]).groupBy(key, "__from", "__to").agg(F.max("top").alias("__top"))
        met = tops.join(rays, key)
        rise = F.col("__top") - z0
        best = elevation_angle(rise, F.when(rise > 0, F.col("__from")).otherwise(F.col("__to")) * step)
        starts = F.sequence(F.col("__from"), F.col("__to"), F.lit(size))
        kept = met.where(best > F.col("__a")).withColumn("__s", F.explode(starts))
        open_ = kept.select(*rays.columns, F.col("__s").alias("__from"), F.least(F.col("__s") + (size - 1), F.col("__to")).alias("__to"))
    row, col = cell(F.col("__from"))
    single = open_.select(key, "__a", "__from", row.alias("row"), col.alias("col"))
    ground = single.join(raster.select("row", "col", F.col("elevation").alias("__z")), ["row", "col"])
    hidden = ground.where(elevation_angle(F.col("__z") - z0, F.col("__from") * step) > F.col("__a")).select(F.col(key).alias("__key")).distinct()
    out = rays.join(hidden, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.select(key, F.col("__d").alias("distance"), F.col("__a").alias("angle"), F.col("__key").isNull().alias("visible"))
