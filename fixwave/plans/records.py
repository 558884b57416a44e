"""Queries of inserts, permissions, calibration samples and dashboard figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixwave.functions import scalar
from fixwave.operators import access
from fixwave.plans.registry import query, table
from fixwave.sources import inserts


def _names(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ID"), F.col("n_name").alias("name"))


@query("""WITH e AS (SELECT event_id AS id, event_type AS tag, user_id, user_id % 4 = 0 AS known FROM events), tags AS (SELECT event_type AS tag, min(event_id) + 1000 AS d FROM events WHERE event_type <> 'error' GROUP BY ALL),
r AS (SELECT e.id, CASE WHEN known THEN 7 ELSE d END AS "deploymentID", n_nationkey AS "siteID" FROM e LEFT JOIN tags USING (tag) LEFT JOIN nation ON n_nationkey = user_id)
SELECT id, "deploymentID", "siteID", CASE WHEN "deploymentID" IS NULL THEN 'deploymentID' WHEN "siteID" IS NULL THEN 'siteID' END AS missing FROM r""")
def k_resolve(spark, sf):
    e = table(spark, sf, "events")
    tx = e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("ID"))
    deployment = tx.select((F.col("ID") + 1000).alias("ID"), F.col("ID").alias("txID"))
    named = e.join(_names(spark, sf).select(F.col("ID").alias("user_id"), F.col("name").alias("sitename")), "user_id", "left")
    rows = named.select(F.col("event_id").alias("id"), F.col("event_type").alias("tagname"), "sitename", F.when(F.col("user_id") % 4 == 0, F.lit(7)).cast("long").alias("deploymentID"), F.lit(None).cast("long").alias("siteID"))
    found, rejects = inserts.resolved(rows, tx, deployment, _names(spark, sf))
    return found.select("id", "deploymentID", "siteID").unionByName(rejects.select("id", "deploymentID", "siteID", "missing"), allowMissingColumns=True)


@query("""WITH b AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders), n AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS v FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY ALL), m AS (SELECT max(id) AS m FROM b)
SELECT b.id, coalesce(n.v, b.v) AS v FROM b LEFT JOIN n ON n.l_orderkey = b.id AND l_linenumber = 1
UNION ALL SELECT m + row_number() OVER (ORDER BY v, l_orderkey), v FROM (SELECT * FROM n WHERE l_linenumber = 2), m""")
def k_insert_or_update(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    n = table(spark, sf, "lineitem").where("l_linenumber in (1, 2)").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("v"))
    rows = n.select(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("id"), "v", "l_orderkey")
    base = base.withColumn("l_orderkey", F.lit(0).cast("long"))
    return inserts.insert_or_update(base, rows, ["v", "l_orderkey"], "id").select("id", "v")


@query("""SELECT n_nationkey AS "siteID", strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, 'UTC' AS timezone, epoch_us(ts) // 1000000 AS timestamp, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS voltage, CAST(json_extract_string(props, '$.k') AS INT) AS ping_power FROM events JOIN nation ON n_nationkey = user_id""")
def k_telemetry(spark, sf):
    e = table(spark, sf, "events").join(_names(spark, sf).withColumnRenamed("ID", "user_id"), "user_id", "left")
    rows = e.select("name", F.floor(scalar.micros(F.col("ts")) / 1_000_000).alias("timestamp"), F.when(F.col("event_type") == "click", " ").otherwise(F.col("value").cast("string")).alias("voltage"), F.get_json_object("props", "$.k").alias("ping_power"))
    found, _ = inserts.telemetry(rows, _names(spark, sf), {"voltage": "double", "ping_power": "int"})
    return found


def _batch(spark, sf):
    o, x = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    at = [(F.col("o_custkey") % 10).alias("deploymentID"), F.col("o_orderkey").cast("double").alias("timestamp")]
    positions = o.select(*at, F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("easting"), F.lit(4000000.0).alias("northing"), F.lit(1.0).alias("likelihood"), F.lit(0.5).alias("activity"), F.lit(2).alias("number_est_used"))
    seen = x.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("bearing"), F.collect_set("l_partkey").alias("est_ids"))
    bearings = o.join(seen, F.col("o_orderkey") == F.col("l_orderkey")).select(*at, F.col("l_linenumber").cast("long").alias("siteID"), "bearing", F.lit(1.0).alias("likelihood"), F.lit(0.5).alias("activity"), F.size("est_ids").alias("number_est_used"), "est_ids")
    covariances = positions.select("deploymentID", "timestamp", F.lit("ok").alias("status"), F.lit("boot").alias("method"), (F.col("easting") / 10).alias("cov11"))
    return inserts.positions_batch(bearings, positions, covariances, 5, (10, "S"), {"bearing": 100, "position": 50})


_BATCH = """WITH p AS (SELECT row_number() OVER (ORDER BY o_custkey % 10, o_orderkey) + 50 AS id, o_orderkey AS k, o_totalprice AS easting FROM orders WHERE o_orderstatus <> 'P'),
x AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS site, l_partkey AS est FROM lineitem), b AS (SELECT row_number() OVER (ORDER BY o_custkey % 10, o_orderkey, site) + 100 AS id, k, site FROM (SELECT DISTINCT k, site FROM x) JOIN orders ON o_orderkey = k)
"""


@query(_BATCH + """SELECT 'bearing' AS obj_table, b.id AS obj_id, 'est' AS dep_table, est AS dep_id FROM b JOIN x USING (k, site)
UNION ALL SELECT 'bearing', id, 'calibration_information', 5 FROM b UNION ALL SELECT 'position', p.id, 'bearing', b.id FROM p JOIN b USING (k)""")
def k_position_provenance(spark, sf):
    return _batch(spark, sf)["provenance"]


@query(_BATCH + """SELECT p.id AS "positionID", CAST(k AS DOUBLE) AS timestamp, easting, 10 AS utm_zone_number, 'ok' AS status, easting / 10 AS cov11 FROM p""")
def k_position_batch(spark, sf):
    out = _batch(spark, sf)
    p = out["position"].select(F.col("ID").alias("positionID"), "timestamp", "easting", "utm_zone_number")
    return p.join(out["covariance"], "positionID").select("positionID", "timestamp", "easting", "utm_zone_number", "status", "cov11")


@query("""WITH l AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events WHERE event_id % 2 = 0),
r0 AS (SELECT event_type, epoch_us(ts) AS t, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
a AS (SELECT l.*, r.t AS ta, r.v AS va FROM l ASOF JOIN r0 r ON l.event_type = r.event_type AND l.t >= r.t),
b AS (SELECT a.*, r.t AS tb, r.v AS vb FROM a ASOF JOIN r0 r ON a.event_type = r.event_type AND a.t <= r.t),
p AS (SELECT event_id, user_id, CASE WHEN tb = ta THEN va ELSE va + (t - ta) / CAST(tb - ta AS DOUBLE) * (vb - va) END AS v FROM b),
d AS (SELECT event_id, v - n_nationkey * 10 AS de, v * 2 - n_nationkey * 5 AS dn, v / 4 - 100.0 AS dz FROM p JOIN nation ON n_nationkey = user_id)
SELECT event_id AS "estID", round(sqrt(de * de + dn * dn), 5) AS d2, round(sqrt(de * de + dn * dn + dz * dz), 5) AS d3, round((degrees(atan2(de, dn)) + 360) % 360, 5) AS bearing, round(degrees(atan2(dz, sqrt(de * de + dn * dn))), 5) AS angle FROM d""")
def k_true_position(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("ID"), F.col("event_type").alias("deploymentID"), F.col("user_id").alias("siteID"), scalar.micros(F.col("ts")).alias("timestamp"), "value")
    gps = e.where("ID % 2 = 1").select("deploymentID", "timestamp", F.col("value").alias("easting"), (F.col("value") * 2).alias("northing"), (F.col("value") / 4).alias("elevation"))
    sites = _names(spark, sf).select("ID", (F.col("ID") * 10.0).alias("easting"), (F.col("ID") * 5.0).alias("northing"), F.lit(100.0).alias("elevation"))
    out = inserts.true_positions(e.where("ID % 2 = 0"), gps, sites)
    return out.select("estID", F.round("2d_distance", 5).alias("d2"), F.round("3d_distance", 5).alias("d3"), F.round("bearing", 5).alias("bearing"), F.round("elevation_angle", 5).alias("angle"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS bearing, o_totalprice AS edsp FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND l_suppkey = 3 AND c_custkey = o_custkey AND c_mktsegment = 'FURNITURE'""")
def j_calibration(spark, sf):
    """True positions of a site's pulses, of deployments that a calibration names: two equi-joins, filtered sides first."""
    true = table(spark, sf, "lineitem").where("l_suppkey = 3").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("bearing"))
    info = table(spark, sf, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    est = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_totalprice").alias("edsp"))
    return true.join(est.join(info, "o_custkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "bearing", "edsp")


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 2 AS cov11, o_totalprice AS easting FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7 AND o_orderkey BETWEEN 10 AND 100000""")
def j_covariance_position(spark, sf):
    p = table(spark, sf, "orders").where("o_custkey = 7 and o_orderkey between 10 and 100000").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("easting"))
    return table(spark, sf, "lineitem").join(p, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("cov11"), "easting")


@query("""SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND c_name LIKE 'Customer#%7'""")
def j_tracks_like(spark, sf):
    names = table(spark, sf, "customer").where(F.col("c_name").like("Customer#%7")).select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = table(spark, sf, "orders").where("o_orderdate between timestamp_ntz'1995-01-01' and timestamp_ntz'1996-01-01'")
    return o.join(names, "o_custkey").select("o_orderkey", "o_orderdate", "c_name")


@query("""SELECT c_custkey, c_acctbal > 0 OR c_nationkey IN (3, 5, 7, 9) AS can_view, c_nationkey IN (3, 5, 7) AS can_change, c_nationkey = 3 AS can_delete FROM customer""")
def f_permissions(spark, sf):
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("ownerID"), (F.col("c_acctbal") > 0).alias("is_public"))
    member = lambda keys: projects.where(F.col("ownerID").isin(keys)).select(F.col("ID").alias("projectID"), F.lit(1).alias("groupID"))
    out = access.permissions(projects, 3, [1], member([7, 9]), member([5, 7]), ["view", "can_change"])
    return out.select(F.col("ID").alias("c_custkey"), "can_view", "can_change", "can_delete")


@query("""SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE (c_acctbal > 0 OR c_nationkey = 3) AND o_orderstatus <> 'P'""")
def f_allowed_rows(spark, sf):
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("ownerID"), (F.col("c_acctbal") > 0).alias("is_public"))
    none = projects.select(F.col("ID").alias("projectID"), F.lit(1).alias("groupID")).limit(0)
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("projectID"), (F.col("o_orderstatus") == "P").alias("is_hidden"))
    return access.allowed(access.visible(rows), access.permissions(projects, 3, [1], none, none, ["view"])).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 40 AND l_linenumber < 5 AND abs(l_discount - 0.05) < 0.03 AND l_extendedprice > 20000 AND l_linestatus = 'O'""")
def f_calibration(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("band3"), F.col("l_linenumber").alias("band10"), (F.col("l_discount") - 0.05).alias("elevation_angle"), F.col("l_extendedprice").alias("distance"), (F.col("l_linestatus") == "O").alias("can_see"))
    return access.calibration_samples(x, 40, 5, 0.03, 20000).select("l_orderkey", "l_linenumber")


@query("""WITH v AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS edsp, CAST(embedding[2] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) + CAST(embedding[4] AS DOUBLE) + CAST(embedding[5] AS DOUBLE) AS tr FROM embeddings)
SELECT label, round(avg(edsp - tr), 6) AS mean_signal, round(stddev_pop(edsp - tr), 6) AS std_signal, round(avg(tr / 4), 6) AS mean_noise, round(stddev_pop(tr / 4), 6) AS std_noise FROM v GROUP BY label""")
def a_noise(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("edsp"), *[F.col("embedding")[c].cast("double").alias(f"nc{c}{c}r") for c in range(1, 5)])
    out = access.noise(e, ["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns if c != "label"])


@query("""WITH t AS (SELECT o_orderpriority AS p, max(o_totalprice) AS top FROM orders GROUP BY ALL)
SELECT o_orderpriority, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM orders JOIN t ON p = o_orderpriority WHERE o_totalprice > 0.9 * top GROUP BY ALL""")
def a_bounding_box(spark, sf):
    return access.bounding_box(table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT event_type, round(86400 / avg(value), 4) AS expected, round(86400 / avg(value) - count(*), 4) AS missed FROM events GROUP BY event_type""")
def a_expected_pulses(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("pi"), F.count("*").alias("found"))
    total, missed = access.expected_pulses(F.lit(86400.0), F.col("pi"), F.col("found"))
    return rows.select("event_type", F.round(total, 4).alias("expected"), F.round(missed, 4).alias("missed"))


@query("""SELECT event_id, round(-0.6324 / (value + 7.764) + 0.1255, 8) AS hyper, 0.1255 AS high FROM events""")
def x_score_error(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(access.score_error(v, "hyper"), 8).alias("hyper"), access.score_error(v).alias("high"))


@query("""WITH n AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Week' WHEN 'view' THEN 'month' WHEN 'purchase' THEN 'YEAR' WHEN 'error' THEN 'soon' ELSE CAST(event_id % 9 AS VARCHAR) END AS name FROM events)
SELECT event_id, CASE lower(name) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 ELSE TRY_CAST(name AS INT) END AS days FROM n""")
def x_duration(spark, sf):
    name = F.expr("case event_type when 'click' then 'Week' when 'view' then 'month' when 'purchase' then 'YEAR' when 'error' then 'soon' else cast(event_id % 9 as string) end")
    return table(spark, sf, "events").select("event_id", access.duration_days(name).alias("days"))


@query("""SELECT event_id, CAST(trunc((value - 100) / 2.5) AS INT) + 50 AS pixel, (CAST(trunc((value - 100) / 2.5) AS INT) + 50 - 50) * 2.5 + 100 AS back FROM events""")
def x_plot_frame(spark, sf):
    pixel = access.plot_frame(F.col("value"), 100.0, 50, 2.5)
    return table(spark, sf, "events").select("event_id", pixel.alias("pixel"), access.from_plot_frame(pixel, 100.0, 50, 2.5).alias("back"))


@query("""SELECT event_id, CASE WHEN user_id - 3 >= 0 THEN greatest(user_id - 3 - event_id % 50 // 4, -1) ELSE user_id - 3 END AS place FROM events""")
def x_pulse_index(spark, sf):
    return table(spark, sf, "events").select("event_id", access.pulse_index(F.col("user_id") - 3, F.col("event_id") % 50).alias("place"))


@query("""SELECT event_type, folder, row_number() OVER (PARTITION BY event_type ORDER BY folder DESC) AS place FROM (SELECT DISTINCT event_type, strftime(ts, '%Y/%m/%d/%H/%M') AS folder FROM events) QUALIFY place <= 20""")
def t_newest_folders(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy/MM/dd/HH/mm").alias("folder"))
    return access.newest(e, ["event_type"], "folder", 20)


@query("""SELECT c_mktsegment, c_nationkey, c_name FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_name LIMIT 40""")
def t_multi_key(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", "c_name").orderBy("c_mktsegment", F.desc("c_nationkey"), "c_name").limit(40)
