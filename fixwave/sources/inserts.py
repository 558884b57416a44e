"""Inserts that make ids: pulses, telemetry, tracks of reference receivers, and bearings, positions and covariances as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.functions import geo
from fixwave.functions.scalar import blank_to_null
from fixwave.operators.access import exists
from fixwave.operators.joins import asof_linear, lookup, small
from fixwave.sources.sinks import assign_ids, provenance, upsert


def table_of(spark: SparkSession, header: list[str], rows: list) -> DataFrame:
    """A table of text columns from rows in memory; a row of another width is an error."""
    wrong = [k for k, r in enumerate(rows) if len(r) != len(header)]
    if wrong:
        raise ValueError(f"row {wrong[0]} has {len(rows[wrong[0]])} values, the header {len(header)}")
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{c}` string" for c in header))


def resolved(rows: DataFrame, tx: DataFrame, deployment: DataFrame, site: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with deploymentID and siteID, looked up by ``tagname`` and ``sitename`` where they are null; and rejects.

    Rejects carry ``missing``: the name of the id that couldn't be resolved, the deployment's first. Of several deployments of
    one name the latest id stands.
    """
    names = tx.select(F.col("ID").alias("txID"), "name").join(deployment.select(F.col("ID").alias("d"), "txID"), "txID")
    tags = names.groupBy(F.col("name").alias("tagname")).agg(F.max("d").alias("__d"))
    sites = site.groupBy(F.col("name").alias("sitename")).agg(F.max("ID").alias("__s"))
    out = rows.join(small(tags), "tagname", "left").join(small(sites), "sitename", "left")
    out = out.withColumns({"deploymentID": F.coalesce("deploymentID", "__d"), "siteID": F.coalesce("siteID", "__s")}).drop("__d", "__s")
    missing = F.when(F.col("deploymentID").isNull(), "deploymentID").when(F.col("siteID").isNull(), "siteID")
    out = out.withColumn("missing", missing)
    return out.where("missing is null").drop("missing"), out.where("missing is not null")


def insert_or_update(base: DataFrame, rows: DataFrame, order: list[str], key: str = "ID") -> DataFrame:
    """``base`` with rows of a known id in place of its own, and rows without one under ids that follow its greatest."""
    rows = rows.select(*base.columns)
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()[0]
    return upsert(base, rows.where(F.col(key).isNotNull()), [key]).unionByName(assign_ids(rows.where(F.col(key).isNull()).drop(key), key, top, order))


def telemetry(rows: DataFrame, sites: DataFrame, values: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows (name, timestamp, values as text) as a telemetry table, and those of unknown sites.

    ``values`` has the column of each text: blank is null, datetime is UTC.
    """
    found, rejects = lookup(rows, sites.select("name", F.col("ID").alias("siteID")), "name", "siteID")
    at = F.date_format(F.timestamp_seconds(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return found.select("siteID", at.alias("datetime"), F.lit("UTC").alias("timezone"), "timestamp", *[blank_to_null(F.col(c)).try_cast(k).alias(c) for c, k in values.items()]), rejects


def insert_gps(base: DataFrame, track: DataFrame, deployment: int, present: str = "abort") -> DataFrame:
    """``base`` with a deployment's track (t, lat, lon, ele) projected; where it has one already: replace, append or abort."""
    if present not in ("replace", "append", "abort"):
        raise ValueError(present)
    own = F.coalesce(F.col("deploymentID") == deployment, F.lit(False))
    if present == "abort" and exists(base.where(own)):
        raise ValueError(f"deployment {deployment} has a track")
    east, north, zone = geo.to_utm(F.col("lat"), F.col("lon"))
    rows = track.select(F.lit(deployment).cast("long").alias("deploymentID"), F.col("t").alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("ele").alias("elevation"), east.alias("easting"), north.alias("northing"), F.concat(zone.cast("string"), geo.zone_letter(F.col("lat"))).alias("zone"))
    return (base.where(~own) if present == "replace" else base).unionByName(rows, allowMissingColumns=True)


def true_positions(est: DataFrame, gps: DataFrame, sites: DataFrame) -> DataFrame:
    """Where each pulse (ID, deploymentID, siteID, timestamp) was sent from, by the deployment's track, and how its site saw it."""
    rows = asof_linear(est.select("ID", "deploymentID", "siteID", "timestamp"), gps.select("deploymentID", "timestamp", "easting", "northing", "elevation"), ["deploymentID"], "timestamp", ["easting", "northing", "elevation"])
    rows = rows.join(small(sites.select(F.col("ID").alias("siteID"), F.col("easting").alias("e"), F.col("northing").alias("n"), F.col("elevation").alias("z"))), "siteID")
    de, dn, dz = F.col("easting") - F.col("e"), F.col("northing") - F.col("n"), F.col("elevation") - F.col("z")
    flat = geo.distance(de, dn)
    return rows.select(F.col("ID").alias("estID"), "easting", "northing", "elevation", flat.alias("2d_distance"), geo.distance_3d(de, dn, dz).alias("3d_distance"), geo.bearing(de, dn).alias("bearing"), geo.elevation_angle(dz, flat).alias("elevation_angle"))


def positions_batch(bearings: DataFrame, positions: DataFrame, covariances: DataFrame | None, cal_id: int, zone: tuple[int, str], after: dict[str, int]) -> dict[str, DataFrame]:
    """Rows of the tables bearing, position, covariance and provenance, with ids that follow ``after``.

    bearings: (deploymentID, siteID, timestamp, bearing, likelihood, activity, number_est_used, est_ids), unique by the first
    three; positions: (deploymentID, timestamp, easting, northing, likelihood, activity, number_est_used), unique by the first
    two; covariances by these two. A window without an easting keeps its bearings but gets no position, hence no covariance.
    Bearings without a window are left out.
    """
    at = ["deploymentID", "timestamp"]
    b = assign_ids(bearings.join(positions.select(*at), at, "left_semi"), "ID", after.get("bearing", 0), [*at, "siteID"])
    p = assign_ids(positions.where(F.col("easting").isNotNull()), "ID", after.get("position", 0), at)
    lat, lon = geo.from_utm(F.col("easting"), F.col("northing"), F.lit(zone[0]), F.lit(zone[1] < "N"))
    p = p.withColumns({"latitude": F.round(lat, 6), "longitude": F.round(lon, 6), "utm_zone_number": F.lit(zone[0]), "utm_zone_letter": F.lit(zone[1])})
    seen = b.select(*at, F.col("ID").alias("dep_id")).join(p.select(*at, F.col("ID").alias("obj_id")), at)
    made = provenance(b, "bearing", "ID", "est", "est_ids").unionByName(b.select(F.lit("bearing").alias("obj_table"), F.col("ID").alias("obj_id"), F.lit("calibration_information").alias("dep_table"), F.lit(cal_id).cast("long").alias("dep_id")))
    made = made.unionByName(seen.select(F.lit("position").alias("obj_table"), "obj_id", F.lit("bearing").alias("dep_table"), "dep_id"))
    out = {"bearing": b.drop("est_ids"), "position": p, "provenance": made}
    if covariances is not None:
        out["covariance"] = covariances.join(p.select(*at, F.col("ID").alias("positionID")), at).drop(*at)
    return out


def commit(tables: dict[str, DataFrame], folder: str, batch: int) -> None:
    """Write all tables of a batch, then its mark; a batch without a mark isn't seen, and a repeated one replaces itself."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    spark.createDataFrame([(batch,)], "batch int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/of={batch}")


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table of all batches that were marked."""
    marks = spark.read.parquet(f"{folder}/batches").select("batch").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(small(marks), "batch", "left_semi").drop("batch")
