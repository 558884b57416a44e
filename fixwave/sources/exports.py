"""Exports that join: transmitters in use, tracks due for publication, plot series, and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.schemas import KEYS, TABLES
from fixwave.sources.tables import typed_parameters


def transmitters(deployment: DataFrame, tx: DataFrame, makes: DataFrame, parameters: DataFrame, kinds: tuple[str, ...] = ("pulse",)) -> DataFrame:
    """Active deployments with their transmitter's frequency, kind and typed parameters."""
    rows = deployment.where("is_active").select(F.col("ID").alias("deploymentID"), "txID").join(tx.select(F.col("ID").alias("txID"), "name", "frequency", "tx_makeID"), "txID")
    rows = rows.join(makes.where(F.col("demod_type").isin(*kinds)).select(F.col("ID").alias("tx_makeID"), "demod_type"), "tx_makeID")
    return rows.join(typed_parameters(parameters), "txID", "left").drop("tx_makeID")


def due(exports: DataFrame, now: float) -> DataFrame:
    """Enabled exports whose interval has passed."""
    return exports.where(F.col("enabled") & (F.col("last_export") + F.col("interval_s") <= now))


def published(jobs: DataFrame, target: DataFrame, deployment: DataFrame, track_pos: DataFrame, position: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Track points since each due job's last export, and the jobs with their time moved on to ``now``."""
    ready = due(jobs, now)
    named = deployment.select(F.col("ID").alias("deploymentID"), "targetID").join(target.select(F.col("ID").alias("targetID"), F.col("name").alias("target")), "targetID")
    points = track_pos.select("positionID", "deploymentID", "timestamp").join(ready.select("deploymentID", "last_export"), "deploymentID")
    points = points.where((F.col("timestamp") > F.col("last_export")) & (F.col("timestamp") <= now))
    rows = points.join(named, "deploymentID").join(position.select(F.col("ID").alias("positionID"), "latitude", "longitude", "likelihood"), "positionID")
    moved = jobs.join(ready.select("deploymentID").withColumn("__due", F.lit(True)), "deploymentID", "left")
    moved = moved.withColumn("last_export", F.when(F.col("__due"), F.lit(float(now))).otherwise(F.col("last_export"))).drop("__due")
    return rows.select("target", "deploymentID", "timestamp", "latitude", "longitude", "likelihood"), moved


def plot_series(df: DataFrame, by: str, at: str, value: str, start: int, end: int, zone: str) -> DataFrame:
    """(by, t, local, value) of a time range with blanks as text; series of one row or none get rows at both ends."""
    rows = df.where(F.col(at).between(start, end)).select(by, F.col(at).cast("long").alias("t"), F.coalesce(F.col(value).cast("string"), F.lit("NULL")).alias("value"))
    few = df.select(by).distinct().join(rows.groupBy(by).count(), by, "left").where("coalesce(count, 0) <= 1").select(by)
    ends = few.select(by, F.explode(F.array(F.lit(start), F.lit(end)).cast("array<bigint>")).alias("t"), F.lit("NULL").alias("value"))
    local = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("t"), zone), "yyyy-MM-dd HH:mm:ss")
    return rows.unionByName(ends).select(by, "t", local.alias("local"), "value")


def stated(spark: SparkSession) -> DataFrame:
    """(table, column, kind, is_key) of the stated schemas."""
    rows = [(t, f.split(" ", 1)[0].strip("`"), f.split(" ", 1)[1], f.split(" ", 1)[0] == KEYS[t]) for t, ddl in TABLES.items() for f in ddl.split(", ")]
    return spark.createDataFrame(rows, "table string, column string, kind string, is_key boolean")


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, kind, position) of some tables, from their schemas alone: what has a given column is a filter of it."""
    rows = [(t, f.name, f.dataType.simpleString(), k) for t, df in tables.items() for k, f in enumerate(df.schema.fields, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, column string, kind string, position long")
