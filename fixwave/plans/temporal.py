"""Queries of windows, sessions and sequences over the event table, and of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixwave.functions import geo, scalar
from fixwave.operators import windows
from fixwave.plans.registry import query, table
from fixwave.sources import tables

_HOUR = 3600


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("t", F.floor(scalar.micros(F.col("ts")) / 1000000).cast("long"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1""")
def w_best_per_ts(spark, sf):
    return windows.best_per_time(table(spark, sf, "events"), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 1000000 AS t FROM events), l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY event_type ORDER BY t) < 3600 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT event_type, t, sum(new) OVER (PARTITION BY event_type ORDER BY t) AS session FROM l)
SELECT event_type, CAST(session AS BIGINT) AS session, min(t) - 1800 AS first, max(t) + 1800 AS last, count(*) AS n FROM s GROUP BY event_type, session""")
def w_sessions(spark, sf):
    return windows.sessions(_events(spark, sf), ["event_type"], "t", 1800).select("event_type", "session", "first", "last", "n")


@query("""SELECT event_type, CAST(epoch_us(ts) // 1000000 // 21600 * 21600 AS BIGINT) AS start, count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL""")
def w_tumbling(spark, sf):
    return _events(spark, sf).groupBy("event_type", windows.tumbling(F.col("t"), 21600).alias("start")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("total"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, epoch_us(ts) // 1000000 // 21600 * 21600 AS s FROM events)
SELECT event_id, s AS interval, true AS core FROM e UNION ALL SELECT event_id, s - 21600, false FROM e WHERE t - s < 3600 UNION ALL SELECT event_id, s + 21600, false FROM e WHERE t - s >= 18000""")
def w_augmented(spark, sf):
    return windows.augmented(_events(spark, sf), "t", 21600, 3600).select("event_id", "interval", "core")


@query("""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 DESC, event_id DESC) AS n FROM events) WHERE n <= 500""")
def w_last_n(spark, sf):
    return windows.last_n(_events(spark, sf), ["event_type"], "t", 500, "event_id").select("event_type", "event_id")


@query("""WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM events),
k AS (SELECT *, greatest(0, CAST(ceil((m - 500) / 400.0) AS BIGINT)) AS final FROM e),
w AS (SELECT event_id, event_type, unnest(range(0, final + 1)) AS window_id, i, m, final FROM k)
SELECT event_type, event_id, window_id FROM w WHERE (i >= window_id * 400 AND i < window_id * 400 + 500) OR (window_id = final AND i >= greatest(m - 500, 0))""")
def w_row_windows(spark, sf):
    return windows.row_windows(_events(spark, sf), ["event_type"], "t", 500, 100, "event_id").select("event_type", "event_id", "window_id")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events),
s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / NULLIF(t - lag(t) OVER w, 0) AS speed, t - (t - lag(t) OVER w) / 2 AS mid FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(speed, 7) AS speed, round((speed - lag(speed) OVER v) / NULLIF(mid - lag(mid) OVER v, 0) * 1000, 5) AS acceleration FROM s WINDOW v AS (PARTITION BY user_id ORDER BY t, event_id)""")
def w_speed_accel(spark, sf):
    e = table(spark, sf, "events").withColumn("t", scalar.micros(F.col("ts")) / 1000000.0).withColumn("y", F.get_json_object("props", "$.k").cast("double"))
    m = windows.movement(e, ["user_id"], "t", "value", "y", "event_id")
    return m.select("event_id", F.round("speed", 7).alias("speed"), F.round(F.col("acceleration") * 1000, 5).alias("acceleration"))


@query("""SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_o_totalprice, arg_max(o_totalprice, o_orderkey) AS last_o_totalprice FROM orders GROUP BY ALL""")
def w_first_last(spark, sf):
    return windows.ends(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice"])


@query("""SELECT event_type, max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS missing FROM events GROUP BY ALL""")
def w_id_gaps(spark, sf):
    return windows.id_gaps(table(spark, sf, "events"), ["event_type"], "event_id")


@query("""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING) AS n_ahead FROM events""")
def w_forward(spark, sf):
    return windows.ahead(_events(spark, sf), ["event_type"], "t", 7200).select("event_id", "n_ahead")


@query("""SELECT c_custkey, round((degrees(atan2(c_acctbal, c_nationkey - 12.5)) + 720) % 360, 6) AS bearing, round(sqrt(c_acctbal ** 2 + (c_nationkey - 12.5) ** 2), 4) AS distance FROM customer""")
def x_bearing(spark, sf):
    e, n = F.col("c_acctbal"), F.col("c_nationkey") - 12.5
    return table(spark, sf, "customer").select("c_custkey", F.round(geo.bearing(e, n), 6).alias("bearing"), F.round(geo.distance(e, n), 4).alias("distance"))


def _points(spark, sf):
    lat = ((F.col("c_custkey") % 157) - 78).cast("double") + 0.25
    lon = ((F.col("c_custkey") * 7) % 359 - 179).cast("double") + 0.125
    return table(spark, sf, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query("""SELECT c_custkey, CAST(c_custkey % 157 - 78 + 0.25 AS DOUBLE) AS lat, CAST((c_custkey * 7) % 359 - 179 + 0.125 AS DOUBLE) AS lon, CAST(floor(((c_custkey * 7) % 359 - 179 + 0.125) / 6) + 31 AS INT) AS zone,
substr('CDEFGHJKLMNPQRSTUVWX', CAST(least(floor((c_custkey % 157 - 78 + 0.25 + 80) / 8), 19) AS INT) + 1, 1) AS letter FROM customer""")
def x_utm_roundtrip(spark, sf):
    p = _points(spark, sf)
    e, n, zone = geo.to_utm(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_utm(e, n, zone, F.col("lat") < 0)
    return p.select("c_custkey", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), zone.alias("zone"), geo.zone_letter(F.col("lat")).alias("letter"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS f, 60 + o_orderkey % 4000 AS dt FROM orders)
SELECT o_orderkey, round(CASE f WHEN 0 THEN 2.0 WHEN 1 THEN greatest(2.0, 20.0 + (8.0 - 20.0) * (dt - 60) / 1740) ELSE 2.0 + 18.0 * exp(-ln(18.0 / 6.0) / 1740 * (dt - 60)) END, 6) AS speed FROM o""")
def x_speed_family(spark, sf):
    family = F.element_at(F.array(F.lit("const"), F.lit("linear"), F.lit("exp")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    dt = (60 + F.col("o_orderkey") % 4000).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", F.round(geo.max_speed(family, F.lit(20.0), F.lit(8.0), F.lit(2.0), dt), 6).alias("speed"))


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS padded, CASE WHEN length(c_name) > 10 THEN c_name[1:10] || '...' ELSE c_name END AS short, NULLIF(trim(substr(c_name, 30)), '') AS blank, lower(lpad(printf('%X', CAST(floor(255 - 235 * (c_custkey % 100) / 100.0) AS BIGINT)), 2, '0')) AS shade FROM customer""")
def x_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", scalar.padded(F.col("c_custkey")).alias("padded"), scalar.shortened(F.col("c_name"), 10).alias("short"), scalar.blank_to_null(F.substring("c_name", 30, 100)).alias("blank"), scalar.shade(F.col("c_custkey") % 100, F.lit(100)).alias("shade"))


@query()
def x_crc32_colour(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalar.colour_index(F.col("c_name"), 12).alias("colour"))


@query("""SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events""")
def x_epoch_local(spark, sf):
    return _events(spark, sf).select("event_id", scalar.local_text(F.col("t"), "-08:00").alias("local"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(NULLIF(regexp_extract(html, '(?is)width[^0-9+-]{0,80}([+-]?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS width, CASE WHEN html ILIKE '%running%' THEN 2 END AS state FROM pages""")
def x_regex_scrape(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), tables.number_after(F.col("html"), "width").alias("width"), F.when(F.lower("html").contains("running"), 2).alias("state"))


@query("""WITH c AS (SELECT l_returnflag, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 100) AS b, var_samp(l_tax * 100) AS c FROM lineitem GROUP BY ALL), e AS (SELECT *, (a + c) / 2 AS h, sqrt((a - c) ** 2 / 4 + b ** 2) AS g FROM c)
SELECT l_returnflag, round(h + g, 3) AS lambda1, round(h - g, 3) AS lambda2, round(0.5 * degrees(atan2(2 * b, a - c)), 3) AS alpha, round(sqrt(5.991 * (h + g)), 3) AS axis1, 'ok' AS status FROM e""")
def x_ellipse(spark, sf):
    c = table(spark, sf, "lineitem").withColumn("x", F.col("l_tax") * 100).groupBy("l_returnflag").agg(F.var_samp("l_quantity").alias("a"), F.covar_samp("l_quantity", "x").alias("b"), F.var_samp("x").alias("c"))
    e = geo.ellipse(F.col("a"), F.col("b"), F.col("c"), F.lit(5.991))
    return c.select("l_returnflag", *[F.round(e[k], 3).alias(k) for k in ("lambda1", "lambda2", "alpha", "axis1")], e["status"].alias("status"))


@query("""SELECT event_id, round(10 * log10(value / 50.0), 5) AS db FROM events WHERE value > 0""")
def x_decibels(spark, sf):
    return table(spark, sf, "events").where("value > 0").select("event_id", F.round(scalar.decibels(F.col("value"), F.lit(50.0)), 5).alias("db"))
