"""Queries of terrain, bands and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixwave.operators import bands, terrain
from fixwave.plans.registry import query, table
from fixwave.sources import exports


@query("""SELECT o_orderkey, CASE WHEN abs(o_totalprice - 150000) <= 8000 * 32 / 2.0 THEN ((CAST(round((o_totalprice - 150000) / 8000) AS INT) % 32) + 32) % 32 END AS band FROM orders""")
def d_band_bins(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", bands.band_of(F.col("o_totalprice"), F.lit(150000.0), 8000.0, 32).alias("band"))


@query("""SELECT o_orderpriority AS band, max(o_orderkey) AS pulse_width, max(o_custkey) AS save_width, min(o_totalprice) AS rise, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY ALL""")
def d_band_merge(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("band"), F.col("o_orderkey").alias("pulse_width"), F.col("o_custkey").alias("save_width"), F.col("o_totalprice").alias("rise"), F.col("o_orderstatus").alias("name"))
    return bands.merged_bands(o, ["band"]).select("band", "pulse_width", "save_width", "rise", F.size("names").alias("n"))


WHERE = terrain.Raster(0.0, 2400.0, 100.0, 25, 25)
_SIGHT = """WITH p AS (SELECT c_custkey AS id, (c_custkey * 37) % 2400 + 5.0 AS e, (c_custkey * 91) % 2400 + 5.0 AS n, 120.0 + c_custkey % 50 AS z FROM customer),
r AS (SELECT a.n_nationkey AS row, b.n_nationkey AS col, (a.n_nationkey * 7 + b.n_nationkey * 11) % 13 * 12.0 AS z FROM nation a CROSS JOIN nation b),
q AS (SELECT *, sqrt((e - 1200) ** 2 + (n - 1200) ** 2) AS d FROM p), s AS (SELECT *, unnest(range(1, greatest(CAST(ceil(d / 50.0) AS BIGINT), 1))) * 50.0 AS s FROM q),
h AS (SELECT s.id, max(degrees(atan2(r.z - 150.0, s.s))) AS a FROM s JOIN r ON r.row = greatest(0, least(24, CAST(round((2400.0 - (1200 + (n - 1200) * s / d)) / 100.0) AS INT))) AND r.col = greatest(0, least(24, CAST(round((1200 + (e - 1200) * s / d) / 100.0) AS INT))) GROUP BY s.id)
SELECT q.id, round(d, 4) AS distance, round(degrees(atan2(q.z - 150.0, d)), 6) AS angle, coalesce(h.a <= degrees(atan2(q.z - 150.0, d)), true) AS visible FROM q LEFT JOIN h ON q.id = h.id"""


@query(_SIGHT)
def d_line_of_sight(spark, sf):
    keys = table(spark, sf, "nation").select("n_nationkey")
    a, b = keys.withColumnRenamed("n_nationkey", "row"), keys.withColumnRenamed("n_nationkey", "col")
    raster = a.crossJoin(F.broadcast(b)).withColumn("elevation", ((F.col("row") * 7 + F.col("col") * 11) % 13) * 12.0).select(F.col("row").cast("int"), F.col("col").cast("int"), "elevation")
    c = F.col("c_custkey")
    points = table(spark, sf, "customer").select(c.alias("id"), ((c * 37) % 2400 + 5.0).alias("easting"), ((c * 91) % 2400 + 5.0).alias("northing"), (120.0 + c % 50).alias("elevation"))
    out = terrain.line_of_sight(points, "id", raster, WHERE, (1200.0, 1200.0, 150.0), 50.0)
    return out.select("id", F.round("distance", 4).alias("distance"), F.round("angle", 6).alias("angle"), "visible")


@query("""WITH j AS (SELECT c_custkey AS d, CAST(c_custkey % 3 = 0 AS BOOLEAN) AS enabled, 100.0 * (c_custkey % 40) AS last FROM customer)
SELECT n_name AS target, o_custkey AS "deploymentID", CAST(o_orderkey AS DOUBLE) AS timestamp, o_totalprice AS likelihood FROM j JOIN customer ON c_custkey = d JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = d WHERE enabled AND last + 1000 <= 4000 AND o_orderkey > last AND o_orderkey <= 4000""")
def k_publish(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    jobs = c.select(F.col("c_custkey").alias("deploymentID"), (F.col("c_custkey") % 3 == 0).alias("enabled"), (100.0 * (F.col("c_custkey") % 40)).alias("last_export"), F.lit(1000.0).alias("interval_s"))
    target = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("name"))
    deployment = c.select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("targetID"))
    pos = o.select(F.col("o_orderkey").alias("ID"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.col("o_totalprice").alias("likelihood"))
    track = o.select(F.col("o_orderkey").alias("positionID"), F.col("o_custkey").alias("deploymentID"), F.col("o_orderkey").cast("double").alias("timestamp"))
    rows, _ = exports.published(jobs, target, deployment, track, pos, 4000.0)
    return rows.select("target", "deploymentID", "timestamp", "likelihood")


@query("""WITH r AS (SELECT user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, CAST(event_id AS VARCHAR) AS value FROM events), b AS (SELECT min(t) + 1000 AS a, min(t) + 400000 AS z FROM r),
x AS (SELECT r.* FROM r, b WHERE t BETWEEN a AND z), f AS (SELECT u.user_id FROM (SELECT DISTINCT user_id FROM r) u LEFT JOIN x ON x.user_id = u.user_id GROUP BY u.user_id HAVING count(x.t) <= 1)
SELECT user_id, t, value FROM x UNION ALL SELECT user_id, a, 'NULL' FROM f, b UNION ALL SELECT user_id, z, 'NULL' FROM f, b""")
def k_plot_series(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), "event_id")
    first = e.agg(F.min("t")).first()[0]
    return exports.plot_series(e, "user_id", "t", "event_id", first + 1000, first + 400000, "UTC").select("user_id", "t", "value")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"""SELECT table_name AS "table", column_name AS "column", CAST(ordinal_position AS BIGINT) AS position FROM information_schema.columns WHERE table_name IN {_TABLES}""")
def s_catalogue(spark, sf):
    return exports.catalogue({t: table(spark, sf, t) for t in _TABLES}).select("table", "column", "position")
