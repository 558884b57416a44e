"""Sinks: upserts and range replacement over Parquet, archives, replication, and exports as CSV, JSON and KML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixwave.operators import pieces


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``base`` whose key isn't in it. A repeated batch changes nothing."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def range_replace(base: DataFrame, new: DataFrame, by: list[str], at: str) -> DataFrame:
    """``base`` without its rows in the closed time range that ``new`` has of each group, and ``new``."""
    spans = new.groupBy(*by).agg(F.min(at).alias("__a"), F.max(at).alias("__z"))
    kept = base.join(spans, by, "left").where(f"__a is null or `{at}` < __a or `{at}` > __z").drop("__a", "__z")
    return kept.select(*base.columns).unionByName(new.select(*base.columns))


def overwrite_days(df: DataFrame, path: str, at: str, by: list[str]) -> None:
    """Replace only the partitions (by, day) that ``df`` has rows of."""
    day = F.date_format(F.timestamp_seconds(F.col(at)), "yyyy-MM-dd")
    df.withColumn("day", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "day").parquet(path)


def assign_ids(df: DataFrame, key: str, after: int, order: list[str]) -> DataFrame:
    """Ids that follow ``after`` in the stated order, without one task for all rows: by ranges of it, whose bounds are fixed."""
    return pieces.numbered(df, [], order, key).withColumn(key, F.col(key) + 1 + after).drop(pieces.PIECE)


def provenance(df: DataFrame, table: str, key: str, of: str, dependencies: str) -> DataFrame:
    """(obj_table, obj_id, dep_table, dep_id) of an array of ids that each row was made from."""
    return df.select(F.lit(table).alias("obj_table"), F.col(key).cast("long").alias("obj_id"), F.lit(of).alias("dep_table"), F.explode(F.col(dependencies).cast("array<bigint>")).alias("dep_id"))


def chunked(df: DataFrame, key: str, last: int, size: int) -> DataFrame:
    """Rows past ``last`` with the name of the file they go to: chunks of ``size`` ids' rows in order, named by first id."""
    rows = df.where(F.col(key) > last)
    rows = assign_ids(rows, "__row", -1, [key])
    chunk = F.floor(F.col("__row") / size)
    first = F.min(key).over(Window.partitionBy("__chunk"))
    return rows.withColumn("__chunk", chunk).withColumn("file", F.lpad(first.cast("string"), 16, "0")).drop("__row", "__chunk")


def archive(df: DataFrame, path: str, key: str, last: int, size: int = 1_000_000, compression: str = "gzip") -> DataFrame:
    """Write rows past the cursor as CSV, a folder for each chunk; returns (file, first_id, last_id, n_rows) for the log."""
    rows = chunked(df, key, last, size)
    rows.repartition("file").sortWithinPartitions(key).write.mode("append").partitionBy("file").option("header", "true").option("quote", "'").option("compression", compression).csv(path)
    return rows.groupBy("file").agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count("*").alias("n_rows"))


def replicate(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of the source with ids past the target's greatest: a plain filter on the id, pushed down to the scan."""
    last = target.agg(F.max(key)).first()[0]
    return source if last is None else source.where(F.col(key) > last)


def write_csv(df: DataFrame, path: str, exclude: list[str] = (), by: list[str] = (), null: str = "") -> None:
    """Full precision, header, append; one folder for each value of ``by``."""
    writer = df.drop(*exclude).write.mode("append").option("header", "true").option("nullValue", null)
    (writer.partitionBy(*by) if by else writer).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row: times as epoch seconds, decimals as numbers."""
    cols = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) / 1_000_000 if k.startswith("timestamp") or k == "date" else F.col(c).cast("double") if k.startswith("decimal") else F.col(c) for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*[x.alias(c) for x, c in zip(cols, df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def kml_points(df: DataFrame, name: str, at: str, lon: str, lat: str, altitude: str | None = None) -> DataFrame:
    """(name, t, placemark): a KML placemark a row, ready to be written in order of name and time."""
    place = F.format_string("<Placemark><name>%s</name><TimeStamp><when>%s</when></TimeStamp><Point><coordinates>%.6f,%.6f,%.1f</coordinates></Point></Placemark>", _escaped(F.col(name).cast("string")), F.date_format(F.timestamp_seconds(F.col(at)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col(lon).cast("double"), F.col(lat).cast("double"), F.col(altitude).cast("double") if altitude else F.lit(0.0))
    return df.select(F.col(name), F.col(at), place.alias("placemark"))


def kml_track(df: DataFrame, by: str, at: str, lon: str, lat: str) -> DataFrame:
    """(by, kml): one gx:Track for each group, of points that were resampled or windowed to a bounded number before."""
    when = F.format_string("<when>%s</when>", F.date_format(F.timestamp_seconds(F.col(at)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    where = F.format_string("<gx:coord>%.6f %.6f 0</gx:coord>", F.col(lon).cast("double"), F.col(lat).cast("double"))
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), when.alias("w"), where.alias("c")))).alias("p"))
    text = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    return rows.select(by, F.concat(F.lit("<Placemark><name>"), _escaped(F.col(by).cast("string")), F.lit("</name><gx:Track>"), text("w"), text("c"), F.lit("</gx:Track></Placemark>")).alias("kml"))


def kml_cloud(df: DataFrame, by: str, key: str, lon: str, lat: str, size: int = 1000) -> DataFrame:
    """(by, part, kml): each group's points as geometries of about ``size`` points, dealt by ``key``, so that no group is gathered whole."""
    many = df.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    rows = df.join(many, by).withColumn("part", F.pmod(F.xxhash64(key), F.col("__n").cast("long")).cast("int"))
    point = F.format_string("<Point><coordinates>%.6f,%.6f,0</coordinates></Point>", F.col(lon).cast("double"), F.col(lat).cast("double"))
    text = F.array_join(F.sort_array(F.collect_list(point)), "")
    return rows.groupBy(by, "part").agg(F.concat(F.lit("<Placemark><name>"), _escaped(F.col(by).cast("string")), F.lit("</name><MultiGeometry>"), text, F.lit("</MultiGeometry></Placemark>")).alias("kml"))


def kml_document(parts: DataFrame, column: str, path: str, order: list[str]) -> None:
    """Write placemarks as text files that together, in order of name, are one KML document."""
    spark: SparkSession = parts.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>'
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/1-head")
    parts.orderBy(*order).select(F.col(column).alias("value")).write.text(f"{path}/2-body")
    spark.createDataFrame([("</Document></kml>",)], "value string").coalesce(1).write.text(f"{path}/3-tail")
