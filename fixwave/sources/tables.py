"""Text and registry sources: delimited tables, GPS tracks, thresholds, status pages, tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.functions.scalar import blank_to_null
from fixwave.schemas import TABLES


def read_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """A table with a header row, plain commas and text columns; a row of another width is an error."""
    from pyspark.sql import types as T

    reader = spark.read.option("header", "true").option("quote", "").option("mode", "FAILFAST").option("enforceSchema", "false")
    return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path) if header else reader.csv(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A telemetry table by its stated schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def by_name(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """A table by its name in any case; an unknown one is an error."""
    found = {k.lower(): v for k, v in tables.items()}
    if name.lower() not in found:
        raise KeyError(f"no table {name}; there are {', '.join(sorted(tables))}")
    return found[name.lower()]


def range_scan(df: DataFrame, at: str, start=None, end=None, closed: bool = True) -> DataFrame:
    """Rows of a time range, closed on both sides or open at its end; as a plain comparison, so that scans can prune."""
    if start is not None:
        df = df.where(F.col(at) >= start)
    if end is not None:
        df = df.where(F.col(at) <= end if closed else F.col(at) < end)
    return df


def signals(est: DataFrame, scores: DataFrame | None, deployment: int, start, end, threshold: float | None = None, include: list[int] = (), exclude: list[int] = ()) -> DataFrame:
    """Signals of a deployment in a closed time range, with eigenvectors conjugated; by threshold of relative score, if given."""
    rows = range_scan(est.where(F.col("deploymentID") == deployment), "timestamp", start, end)
    if threshold is not None:
        rows = rows.join(scores, rows["ID"] == scores["estID"]).where(F.try_divide(F.col("score"), F.col("theoretical_score")) >= threshold)
    if include:
        rows = rows.where(F.col("siteID").isin(list(include)))
    if exclude:
        rows = rows.where(~F.col("siteID").isin(list(exclude)))
    return rows.withColumns({f"ed{c}i": -F.col(f"ed{c}i") for c in range(1, 5)})


#: The columns of a site list; ``nil`` as a power switch means that there is none, and -1 as an outlet likewise.
SITE_LIST = ["name", "comp_ip", "power_ip", "comp_outlet", "rx_outlet", "powertype", "state", "auto", "schedule"]
SCHEDULE = r"^\s*([0-9]{1,2}):([0-9]{2})\s*-\s*([0-9]{1,2}):([0-9]{2})\s*$"


def site_list(spark: SparkSession, path: str) -> DataFrame:
    """The sites of a list with their types: outlets or null, ``has_power`` and ``is_auto`` as flags, and the schedule's bounds in
    minutes of the day; a schedule that can't be read has nulls, and a site without a name isn't one."""
    rows = read_csv(spark, path, SITE_LIST)
    text = {c: blank_to_null(F.col(c)) for c in ("name", "comp_ip", "power_ip", "powertype", "state", "schedule")}
    outlet = lambda c: F.when(F.trim(c).try_cast("int") >= 0, F.trim(c).try_cast("int")).alias(c)
    minutes = lambda k: (F.nullif(F.regexp_extract("schedule", SCHEDULE, k), F.lit("")).try_cast("int") * 60 + F.nullif(F.regexp_extract("schedule", SCHEDULE, k + 1), F.lit("")).try_cast("int"))
    return rows.where(text["name"].isNotNull()).select(
        *[text[c].alias(c) for c in ("name", "comp_ip", "power_ip")], outlet("comp_outlet"), outlet("rx_outlet"), F.nullif(text["powertype"], F.lit("nil")).alias("powertype"),
        (F.coalesce(text["powertype"], F.lit("nil")) != "nil").alias("has_power"), text["state"].alias("state"), (F.coalesce(F.lower(F.trim("auto")), F.lit("")) == "auto").alias("is_auto"),
        text["schedule"].alias("schedule"), minutes(1).alias("opens"), minutes(3).alias("closes"),
    )


def read_gpx(spark: SparkSession, path: str, kind: str = "trkpt") -> DataFrame:
    """(name, t, lat, lon, ele) of track points or way points (kind wpt)."""
    schema = "_lat double, _lon double, ele double, time string, name string"
    rows = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)
    return rows.select("name", F.unix_timestamp(F.to_timestamp("time")).alias("t"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(variable, limit, colour) of lines ``$variable,limit:colour,...``; MAX is no limit."""
    lines = spark.read.text(path).where(F.col("value").startswith("$"))
    parts = lines.select(F.split("value", ",").alias("p"))
    pairs = parts.select(F.expr("substring(p[0], 2)").alias("variable"), F.explode(F.slice("p", 2, 1000)).alias("x")).select("variable", F.split(F.trim("x"), ":").alias("x"))
    limit = F.when(F.col("x")[0] == "MAX", F.lit(float("inf"))).otherwise(F.col("x")[0].cast("double"))
    return pairs.select("variable", limit.alias("limit"), F.col("x")[1].cast("int").alias("colour"))


def number_after(text: Column, label: str) -> Column:
    """The first number after a label in a page; null if blank or absent."""
    return blank_to_null(F.regexp_extract(text, rf"(?is){label}[^0-9+-]{{0,80}}([+-]?[0-9]+(?:\.[0-9]+)?)", 1)).cast("double")


def power_page(html: Column) -> dict[str, Column]:
    return {name: number_after(html, label) for name, label in (("internal_temp", "internal temp"), ("external_temp", "external temp"), ("voltage", "volt"), ("current", "current"))}


def ping_flag(text: Column) -> Column:
    return F.when(text.rlike(r"\b[1-9][0-9]* (?:packets )?received"), 1).when(text.isNotNull(), 0)


def status_code(text: Column, states: tuple[str, ...] = ("off", "starting", "running", "stopping", "idle", "error")) -> Column:
    """The place of the first known state that a status text names; null if none."""
    out = F.lit(None).cast("int")
    for k, s in reversed(list(enumerate(states))):
        out = F.when(F.lower(text).contains(s), k).otherwise(out)
    return out


def clock_offset(line: Column) -> Column:
    """Milliseconds of the selected peer (the line marked ``*``) of a peer list."""
    return F.when(line.startswith("*"), F.try_element_at(F.split(F.trim(line), r"\s+"), F.lit(9)).cast("double"))


def typed_parameters(eav: DataFrame, key: str = "txID") -> DataFrame:
    """band3, band10, pulse_rate and pulse_width of each transmitter; a blank limit is none."""
    wide = eav.groupBy(key).pivot("name", ["band3", "band10", "pulse_rate", "pulse_width"]).agg(F.max(blank_to_null(F.col("value"))))
    return wide.select(key, F.col("band3").cast("int"), F.col("band10").cast("int"), F.col("pulse_rate").cast("double"), F.col("pulse_width").cast("double"))


_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def complex_parts(text: Column) -> tuple[Column, Column]:
    """Real and imaginary part of a complex literal like ``(0.1-2e-05j)``; a part that isn't there is 0."""
    bare = F.regexp_replace(text, r"[()\s]", "")
    part = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(bare, pattern, 1), F.lit("")).cast("double"), F.lit(0.0))
    return part(f"^({_NUMBER})(?:$|[+-])"), part(f"({_NUMBER})j$")


def _with_complex(rows: DataFrame, plain: list[tuple[str, str]], names: list[str], delimiter: str) -> DataFrame:
    parts = F.split("value", F.lit("\\" + delimiter))
    cols = [F.trim(parts[k]).cast(kind).alias(c) for k, (c, kind) in enumerate(plain)]
    for k, name in enumerate(names, len(plain)):
        re, im = complex_parts(parts[k])
        cols += [re.alias(f"{name}r"), im.alias(f"{name}i")]
    return rows.select(*[c for c in ("siteID",) if c in rows.columns], *cols)


def _body(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*[0-9]"))  # not the header


def read_signal_files(spark: SparkSession, paths: dict[int, str], delimiter: str = ",") -> DataFrame:
    """Signals of some sites' files: id, t, edsp, tnp, then four channels and the 4 x 4 noise covariance as complex literals."""
    names = [f"ed{c}" for c in range(1, 5)] + [f"nc{a}{b}" for a in range(1, 5) for b in range(1, 5)]
    rows = None
    for site, path in paths.items():
        one = _body(spark, path).withColumn("siteID", F.lit(site).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    return _with_complex(rows, [("ID", "long"), ("timestamp", "double"), ("edsp", "double"), ("tnp", "double")], names, delimiter)


def read_steering_file(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Steering vectors of a file: site, id, bearing, then four channels as complex literals."""
    return _with_complex(_body(spark, path), [("siteID", "long"), ("ID", "long"), ("bearing", "double")], [f"sv{c}" for c in range(1, 5)], delimiter)


#: Detector of each type of transmitter, and what marks a transmitter as used.
DETECTORS = {"pulse": "pulse", "continuous": "continuous", "other": "continuous"}
USED = ["Y", "y", "yes", "Yes", "YES"]


def transmitters(rows: DataFrame) -> DataFrame:
    """A transmitter table as text with its types: used rows only if it says so; a type that isn't known is an error."""
    if "use" in rows.columns:
        rows = rows.where(F.col("use").isin(USED))
    kind = F.raise_error(F.concat(F.lit("no detector for "), F.coalesce("type", F.lit("null")))).cast("string")
    for k, v in DETECTORS.items():
        kind = F.when(F.lower("type") == k, v).otherwise(kind)
    numbers = ["frequency", "pulse_width", "rise_trigger", "time_constant" if "time_constant" in rows.columns else "filter_alpha"]
    return rows.withColumns({**{c: F.col(c).cast("double") for c in numbers}, "type": kind})
