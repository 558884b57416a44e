"""Queries of readers, writers and helpers over whole tables: scans, signals, text tables, parameters, folders, local times, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixwave.functions import scalar
from fixwave.operators import aggregates, direction, filters, position, track
from fixwave.plans.domain import _fixes, simulated
from fixwave.plans.registry import query, table
from fixwave.session import shared
from fixwave.sources import exports, sinks, tables
from fixwave.streaming import batches


@query("""SELECT event_id FROM events WHERE epoch_us(ts) >= 1704153600000000 AND epoch_us(ts) < 1705276800000000""")
def s_range_scan(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return tables.range_scan(e, "at", F.timestamp_seconds(F.lit(1704153600)), F.timestamp_seconds(F.lit(1705276800)), closed=False).select("event_id")


@query("""SELECT vec_id AS "ID", vec_id % 5 AS "siteID", CAST(embedding[1] AS DOUBLE) AS ed1r, -CAST(embedding[2] AS DOUBLE) AS ed1i FROM embeddings WHERE label = 3 AND vec_id >= 50 AND vec_id % 11 / 10.0 >= 0.4 AND vec_id % 5 IN (0, 1, 2) AND vec_id % 5 <> 2""")
def s_signals(spark, sf):
    e = table(spark, sf, "embeddings")
    est = e.select(F.col("vec_id").alias("ID"), F.col("label").alias("deploymentID"), (F.col("vec_id") % 5).alias("siteID"), F.col("vec_id").cast("double").alias("timestamp"), *[F.col("embedding")[i].cast("double").alias(f"ed{i // 2 + 1}{'ri'[i % 2]}") for i in range(8)])
    scores = e.select(F.col("vec_id").alias("estID"), (F.col("vec_id") % 11).alias("score"), F.lit(10).alias("theoretical_score"))
    return tables.signals(est, scores, 3, 50.0, None, 0.4, [0, 1, 2], [2]).select("ID", "siteID", "ed1r", "ed1i")


@query("""SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer""")
def k_csv(spark, sf):
    """The customers as text tables, a folder for each nation, without one column; read back."""
    folder = shared(spark, "csv")
    sinks.write_csv(table(spark, sf, "customer"), folder, exclude=["c_mktsegment"], by=["c_nationkey"])
    back = tables.read_csv(spark, folder)
    return back.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("int"))


@query("""SELECT event_id, CASE WHEN strftime(ts, '%d') IN ('05', '06') THEN -value ELSE value END AS value FROM events""")
def k_overwrite_days(spark, sf):
    """All events by type and day; those of two days written again with other values, which replaces these days alone."""
    folder = shared(spark, "days")
    e = table(spark, sf, "events").select("event_id", "event_type", (scalar.micros(F.col("ts")) / 1e6).alias("t"), "value")
    sinks.overwrite_days(e, folder, "t", ["event_type"])
    again = e.where(F.date_format(F.timestamp_seconds("t"), "dd").isin("05", "06")).withColumn("value", -F.col("value"))
    sinks.overwrite_days(again, folder, "t", ["event_type"])
    return spark.read.parquet(folder).select("event_id", "value")


@query("""SELECT c_custkey AS "deploymentID", n_name AS name, CAST(150 + n_nationkey AS DOUBLE) AS frequency, n_regionkey * 10 AS band3, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS band10, CAST(1.5 AS DOUBLE) * n_nationkey AS pulse_rate
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 AND r_regionkey % 2 = 0""")
def k_transmitters(spark, sf):
    n, c, r = table(spark, sf, "nation"), table(spark, sf, "customer"), table(spark, sf, "region")
    tx = n.select(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("name"), (150.0 + F.col("n_nationkey")).alias("frequency"), F.col("n_regionkey").alias("tx_makeID"))
    makes = r.select(F.col("r_regionkey").alias("ID"), F.when(F.col("r_regionkey") % 2 == 0, "pulse").otherwise("cont").alias("demod_type"))
    value = F.array(F.struct(F.lit("band3").alias("name"), (F.col("n_regionkey") * 10).cast("string").alias("value")), F.struct(F.lit("band10").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(" ").alias("value")), F.struct(F.lit("pulse_rate").alias("name"), (1.5 * F.col("n_nationkey")).cast("string").alias("value")))
    parameters = n.select(F.col("n_nationkey").alias("txID"), F.inline(value))
    active = c.select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("txID"), (F.col("c_acctbal") > 0).alias("is_active"))
    return exports.transmitters(active, tx, makes, parameters).select("deploymentID", "name", "frequency", "band3", "band10", "pulse_rate")


@query("""SELECT event_id FROM events WHERE date_trunc('minute', ts) <= TIMESTAMP '2024-01-19 23:58:00'""")
def f_cold_folders(spark, sf):
    path = F.concat_ws("/", F.lit("/det"), "event_type", F.date_format("ts", "yyyy/MM/dd/HH/mm"), F.concat(F.col("event_id").cast("string"), F.lit(".det")))
    return filters.cold_folders(table(spark, sf, "events").select("event_id", path.alias("path")), "path", "2024-01-20 00:00:00").select("event_id")


@query("""SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 <= 1705276800 - 120""")
def f_settled(spark, sf):
    e = table(spark, sf, "events").select("event_id", (scalar.micros(F.col("ts")) / 1e6).alias("at"))
    return batches.settled(e, "at", 1705276800.0).select("event_id")


@query("""SELECT 'score' AS process, CAST(7 AS DOUBLE) AS start_time, CAST(2.5 AS DOUBLE) AS duration, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS num_input, CAST(11 AS BIGINT) AS num_output FROM events""")
def k_statistics(spark, sf):
    out = batches.statistics("score", 7.0, 2.5, table(spark, sf, "events").select("event_id"), "event_id", 11)
    return out.withColumns({"start_time": F.col("start_time").cast("double"), "duration": F.col("duration").cast("double")})


@query("""WITH t AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS ts, make_date(CAST(year(o_orderdate) AS INT), 4, 1) AS april, make_date(CAST(year(o_orderdate) AS INT), 10, 31) AS october FROM orders),
d AS (SELECT *, april + CAST((7 - dayofweek(april)) % 7 AS INT) + INTERVAL 10 HOUR AS a, october - CAST(dayofweek(october) AS INT) + INTERVAL 9 HOUR AS b FROM t)
SELECT o_orderkey, strftime(ts - to_hours(CASE WHEN ts >= a AND ts < b THEN 7 ELSE 8 END), '%Y-%m-%d %H:%M:%S') AS local,
CAST(epoch_us(ts) // 1000000 - CASE WHEN ts >= b AND ts < b + INTERVAL 1 HOUR THEN 3600 ELSE 0 END AS BIGINT) AS back FROM d""")
def x_local_summer(spark, sf):
    """Local times of all orders in a zone with daylight saving (rules of 1987 to 2006), and back: an hour that the clock has twice
    is read as its first."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.floor(scalar.micros(F.col("o_orderdate")) / 1000000) + (F.col("o_orderkey") % 24) * 3600).alias("t"))
    local = scalar.local_text(F.col("t"), "America/Los_Angeles")
    return o.select("o_orderkey", local.alias("local")).withColumn("back", scalar.epoch_of(F.col("local"), "America/Los_Angeles"))


@query("""SELECT c_custkey, 'Site ' || c_custkey AS label, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, 'NULL') AS segment FROM customer""")
def x_labels(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", scalar.site_label(F.concat(F.lit("site"), F.col("c_custkey").cast("string"))).alias("label"), scalar.null_to_text(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))).alias("segment"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS ping, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 4 END AS code, CAST(event_id % 90 AS DOUBLE) + 0.5 AS voltage, CASE WHEN event_id % 2 = 0 THEN CAST(-(event_id % 39 + 1) AS DOUBLE) END AS internal_temp FROM events""")
def x_status(spark, sf):
    e = table(spark, sf, "events")
    word = F.element_at(F.array(*map(F.lit, ("is Running", "switched OFF", "idle now", "unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    html = F.concat(F.lit("<tr><td>Internal Temp</td><td>"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("-"), (F.col("event_id") % 39 + 1).cast("string"))).otherwise(""), F.lit("</td></tr>" + " " * 90 + "<tr><td>Voltage:</td><td>"), (F.col("event_id") % 90).cast("string"), F.lit(".5 V</td></tr>"))
    page = tables.power_page(html)
    ping = F.concat(F.lit("3 packets transmitted, "), (F.col("event_id") % 3).cast("string"), F.lit(" packets received"))
    return e.select("event_id", tables.ping_flag(ping).alias("ping"), tables.status_code(word).alias("code"), page["voltage"].alias("voltage"), page["internal_temp"].alias("internal_temp"))


@query("""WITH h AS (SELECT CASE WHEN v = 10 THEN 74 WHEN v >= 0 AND v < 10 THEN CAST(floor(v / 10 * 75) AS INT) END AS bin FROM (SELECT l_quantity / 4.0 AS v FROM lineitem)), c AS (SELECT bin, count(*) AS n FROM h WHERE bin IS NOT NULL GROUP BY bin)
SELECT bin, n, round(n / sum(n) OVER () / (10.0 / 75), 9) AS density FROM c""")
def a_hist_speed(spark, sf):
    v = table(spark, sf, "lineitem").select((F.col("l_quantity") / 4.0).alias("v"), F.lit(0).alias("of"))
    return aggregates.density_histogram(v, ["of"], "v", 0.0, 10.0, 75).select("bin", "n", F.round("density", 9).alias("density"))


@query("""WITH e AS (SELECT event_type AS d, event_id AS id, epoch_us(ts) / 1e6 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)
SELECT b.d AS deployment, b.id FROM e b WHERE NOT EXISTS (SELECT 1 FROM e a WHERE a.d = b.d AND a.t < b.t AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (b.t - a.t) < greatest(0.001, 0.01 + (0.004 - 0.01) * (b.t - a.t - 60) / 1740.0) AND b.t - a.t < 90000)""")
def d_roots(spark, sf):
    """Points of the feasible transitions that no point leads to: where tracks can begin."""
    e, _ = _fixes(spark, sf)
    rows = e.withColumns({"family": F.lit("linear"), "burst": F.lit(0.01), "sustained": F.lit(0.004), "speed_limit": F.lit(0.001)})
    return track.unreached(rows, ["deployment"], 90_000).select("deployment", "id")


@query()
def d_single_position(spark, sf):
    """One position of all ``embeddings`` as pulses of three sites, on the usual grids: the whole range as a window."""
    sites, vectors, _ = simulated(spark, seconds=2)
    e = table(spark, sf, "embeddings")
    pulses = e.select(F.lit(0).alias("deployment"), (F.col("vec_id") % 3).cast("int").alias("site"), F.col("vec_id").alias("t"), *[F.col("embedding")[i].cast("double").alias(f"ed{i // 2 + 1}{'ri'[i % 2]}") for i in range(8)])
    return position.positions(position.single_bearings(pulses, direction.packed_steering(vectors)), sites, 500.0)
