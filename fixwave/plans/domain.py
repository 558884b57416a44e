"""Queries of scoring, direction, position, tracks, detection and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fixwave.config import Detector, Positioning, Scoring
from fixwave.functions import scalar
from fixwave.operators import direction, position, scoring, track
from fixwave.plans.registry import query, table
from fixwave.sources import sinks

#: Events are minutes apart, not milliseconds, so they are scored by a configuration scaled up.
SLOW = Scoring(interval_ms=21_600_000, context_ms=3_600_000, bin_ms=60_000, mode_bin_ms=120_000, reach_ms=7_200_000, burst_rate=3.0)
RATE = 60_000 / 1_800_000  # pulses a minute: one in half an hour


def _pulses(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit(0).alias("deployment"), F.col("event_type").alias("site"), scalar.millis(F.col("ts")).alias("t"), F.get_json_object("props", "$.k").cast("int").alias("band10"), F.lit(None).cast("int").alias("band3"))


_SCORE = """WITH p AS (SELECT event_id AS id, event_type AS site, epoch_us(ts) // 1000 AS t, CAST(json_extract_string(props, '$.k') AS INT) > 95 AS flagged FROM events),
a AS (SELECT *, t // 21600000 * 21600000 AS s FROM p), r0 AS (SELECT id, site, t, flagged, s AS i, true AS core FROM a UNION ALL SELECT id, site, t, flagged, s - 21600000, false FROM a WHERE t - s < 3600000 UNION ALL SELECT id, site, t, flagged, s + 21600000, false FROM a WHERE t - s >= 18000000),
b AS (SELECT site, i, least((t - i + 3600000) // 4800000, 5) AS k, count(*) AS n FROM r0 WHERE NOT flagged GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY site, i) AS m FROM b), bad AS (SELECT site, i, i - 3600000 + k * 4800000 AS low FROM c WHERE m >= 20 AND n / 10.0 > 3.0),
r AS (SELECT r0.*, NOT flagged AND EXISTS (SELECT 1 FROM bad WHERE bad.site = r0.site AND bad.i = r0.i AND r0.t >= low AND r0.t <= low + 4800000) AS burst FROM r0), f AS (SELECT * FROM r WHERE NOT flagged AND NOT burst),
g AS (SELECT x.i, y.t - x.t AS gap FROM f x JOIN f y ON x.site = y.site AND x.i = y.i AND y.t - x.t > 60000 * 0.33 / (60000 / 1800000.0) AND y.t - x.t < 60000 * 1.67 / (60000 / 1800000.0)),
h0 AS (SELECT i, min(gap) AS low, max(gap) AS high, CAST(1 + floor((max(gap) - min(gap)) / 120000.0) AS BIGINT) AS bins FROM g GROUP BY ALL),
h AS (SELECT i, low, high, bins, least(CAST(floor(coalesce((gap - low) * bins / NULLIF(CAST(high - low AS DOUBLE), 0), 0)) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM g JOIN h0 USING (i) GROUP BY ALL),
m AS (SELECT i, CAST(arg_max(floor(low + (bin + 0.5) * ((high - low) / CAST(bins AS DOUBLE))), n * 1000000 - bin) AS BIGINT) AS mode, sum(n) AS n FROM h GROUP BY ALL),
k AS (SELECT site, i, CASE WHEN c > 2 AND m.n > 2 THEN m.mode ELSE 0 END AS pi FROM (SELECT site, i, count(*) AS c FROM r GROUP BY ALL) LEFT JOIN m USING (i)),
q AS (SELECT f.*, pi, t // 60000 * 60000 AS own FROM f JOIN k USING (site, i)), occ AS (SELECT site, i, own AS bin, count(*) AS n FROM q GROUP BY ALL),
pr AS (SELECT DISTINCT site, i, id, own, (t + k * pi) // 60000 * 60000 AS bin FROM (SELECT *, unnest(range(1 - 7200000 // pi, 7200000 // pi)) AS k FROM q WHERE pi > 0 AND pi <= 7200000)), hit AS (SELECT pr.site, pr.i, id, count(*) AS hits FROM pr JOIN occ ON occ.site = pr.site AND occ.i = pr.i AND occ.bin = pr.bin GROUP BY ALL),
sc AS (SELECT q.id, q.site, q.i, q.core, pi, CASE WHEN pi = 0 THEN 0 WHEN occ.n > 1 THEN 0 WHEN pi > 7200000 THEN -1 ELSE coalesce(hits, 0) - 1 END AS score FROM q JOIN occ ON occ.site = q.site AND occ.i = q.i AND occ.bin = q.own LEFT JOIN hit ON hit.site = q.site AND hit.i = q.i AND hit.id = q.id
UNION ALL SELECT id, site, i, core, pi, CASE WHEN flagged THEN -1 ELSE -2 END FROM r JOIN k USING (site, i) WHERE flagged OR burst),
z AS (SELECT *, CASE WHEN pi > 0 THEN max(score) OVER (PARTITION BY site, i) ELSE 0 END AS top FROM sc)
SELECT id, site, i AS interval, CAST(score AS BIGINT) AS score, CAST(CASE WHEN pi > 0 THEN 14400000 // pi ELSE 0 END AS BIGINT) AS theoretical_score, CAST(top AS BIGINT) AS max_score FROM z WHERE core"""


@query(_SCORE)
def d_score(spark, sf):
    limits = spark.createDataFrame([(0, None, 95)], "deployment int, limit3 int, limit10 int")
    out, _ = scoring.score(_pulses(spark, sf), RATE, limits, SLOW)
    return out.select("id", "site", "interval", "score", "theoretical_score", "max_score")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b, CAST(embedding[3] AS DOUBLE) c, CAST(embedding[4] AS DOUBLE) d, CAST(embedding[5] AS DOUBLE) e, CAST(embedding[6] AS DOUBLE) f, CAST(embedding[7] AS DOUBLE) g, CAST(embedding[8] AS DOUBLE) h FROM embeddings),
s AS (SELECT label AS bearing, avg(a) a, avg(b) b, avg(c) c, avg(d) d, avg(e) e, avg(f) f, avg(g) g, avg(h) h FROM v GROUP BY label),
p AS (SELECT vec_id, bearing, (v.a*s.a+v.b*s.b+v.c*s.c+v.d*s.d+v.e*s.e+v.f*s.f+v.g*s.g+v.h*s.h)**2 + (v.b*s.a-v.a*s.b+v.d*s.c-v.c*s.d+v.f*s.e-v.e*s.f+v.h*s.g-v.g*s.h)**2 AS power FROM v CROSS JOIN s)
SELECT vec_id, CAST(arg_max(bearing, power) AS INT) AS bearing, round(max(power), 5) AS power FROM p GROUP BY vec_id""")
def d_bartlett(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0).alias("site"), *[F.col("embedding")[i].cast("double").alias(f"ed{i // 2 + 1}{'ri'[i % 2]}") for i in range(8)])
    s = e.groupBy(F.col("label").alias("bearing"), "site").agg(*[F.avg(f"ed{c}{p}").alias(f"sv{c}{p}") for c in range(1, 5) for p in "ri"])
    both = direction.bartlett(e.select("vec_id", "site", *[c for c in e.columns if c.startswith("ed")]), s, ["site"])
    return both.groupBy("vec_id").agg(F.max_by("bearing", "power").alias("bearing"), F.round(F.max("power"), 5).alias("power"))


def simulated(spark, n: int = 3, seconds: int = 120, noise: float = 0.0):
    """Sites, steering vectors and pulses of a transmitter at a known point: easting 200 m, northing 300 m."""
    rng = np.random.default_rng(7)
    sites = [(k, float(1000 * np.cos(2 * np.pi * k / n)), float(1000 * np.sin(2 * np.pi * k / n))) for k in range(n)]
    angle = np.radians(np.arange(360))
    element = np.pi * np.stack([np.cos(angle), np.sin(angle), -np.cos(angle), -np.sin(angle)], axis=1) / 2
    g = np.exp(1j * element) / 2
    vectors = [(k, b, *[float(x) for z in g[b] for x in (z.real, z.imag)]) for k in range(n) for b in range(360)]
    pulses = []
    for k, e, nn in sites:
        true = np.degrees(np.arctan2(200.0 - e, 300.0 - nn)) % 360
        v0 = np.exp(1j * np.pi / 2 * np.array([np.cos(np.radians(true)), np.sin(np.radians(true)), -np.cos(np.radians(true)), -np.sin(np.radians(true))])) / 2
        for t in range(0, seconds, 2):
            v = v0 + noise * (rng.normal(size=4) + 1j * rng.normal(size=4))
            pulses.append((0, k, t, *[float(x) for z in v for x in (z.real, z.imag)]))
    names = [f"{c}{p}" for c in range(1, 5) for p in "ri"]
    return (
        spark.createDataFrame(sites, "site int, easting double, northing double"),
        spark.createDataFrame(vectors, "site int, bearing int, " + ", ".join(f"sv{x} double" for x in names)),
        spark.createDataFrame(pulses, "deployment int, site int, t long, " + ", ".join(f"ed{x} double" for x in names)),
    )


@query()
def d_position(spark, sf):
    """Positions from the channels of all ``embeddings`` as pulses of three sites, one a second, on the usual grids."""
    sites, vectors, _ = simulated(spark, seconds=2)
    e = table(spark, sf, "embeddings")
    pulses = e.select(F.lit(0).alias("deployment"), (F.col("vec_id") % 3).cast("int").alias("site"), F.col("vec_id").alias("t"), *[F.col("embedding")[i].cast("double").alias(f"ed{i // 2 + 1}{'ri'[i % 2]}") for i in range(8)])
    sums = position.bearings(pulses, direction.packed_steering(vectors), Positioning())
    return position.positions(sums, sites, 500.0, Positioning())


def _fixes(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("deployment"), F.col("event_id").alias("id"), (scalar.micros(F.col("ts")) / 1e6).alias("t"), F.col("value").alias("easting"), F.get_json_object("props", "$.k").cast("double").alias("northing"), (F.col("value") / 100).alias("likelihood"))
    targets = spark.createDataFrame([(k, "linear", 0.5, 0.1, 0.05) for k in ("click", "view", "purchase", "signup", "error", "search", "logout", "login", "share", "refund")], "deployment string, family string, burst double, sustained double, speed_limit double")
    return e, targets


#: Windows of 500 rows that share 100; in each, the best sum up to every point in order of time, and the way back from the best.
_TRACK = """WITH RECURSIVE p AS (SELECT event_type AS d, event_id AS id, epoch_us(ts) / 1e6 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, value / 100 AS ll FROM events),
q AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY d) AS m FROM p),
w AS (SELECT *, CAST(greatest(0, ceil((m - 500) / 400.0)) AS BIGINT) AS final, CAST(greatest(0, ceil((i - 499) / 400.0)) AS BIGINT) AS low FROM q),
r AS (SELECT d, id, t, x, y, ll, unnest(list_distinct(list_concat(range(low, least(i // 400, final) + 1), CASE WHEN i >= greatest(m - 500, 0) THEN [final] ELSE CAST([] AS BIGINT[]) END))) AS win FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY d, win ORDER BY t, id) AS v FROM r),
e AS (SELECT b.d, b.win, b.v, list(a.v ORDER BY a.v) AS before FROM n a JOIN n b ON a.d = b.d AND a.win = b.win AND a.t < b.t WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (b.t - a.t) < greatest(0.05, 0.5 + (0.1 - 0.5) * (b.t - a.t - 60) / 1740.0) GROUP BY ALL),
nodes AS (SELECT n.d, n.win, n.v, n.ll, coalesce(e.before, CAST([] AS BIGINT[])) AS before FROM n LEFT JOIN e ON n.d = e.d AND n.win = e.win AND n.v = e.v),
g AS (SELECT DISTINCT d, win, CAST(0 AS BIGINT) AS v, CAST([] AS DOUBLE[]) AS dist, CAST([] AS BIGINT[]) AS back FROM nodes
UNION ALL SELECT d, win, v, list_append(dist, CASE WHEN best > 0 THEN best ELSE 0 END + ll), list_append(back, CASE WHEN best > 0 THEN before[list_position(reach, best)] ELSE 0 END) FROM (
SELECT *, list_max(reach) AS best FROM (SELECT g.d, g.win, nodes.v, g.dist, g.back, nodes.ll, nodes.before, [g.dist[u] FOR u IN nodes.before] AS reach FROM g JOIN nodes ON g.d = nodes.d AND g.win = nodes.win AND nodes.v = g.v + 1) a) b),
ends AS (SELECT d, win, dist, back, list_position(dist, list_max(dist)) AS v FROM g QUALIFY row_number() OVER (PARTITION BY d, win ORDER BY len(dist) DESC) = 1),
way AS (SELECT d, win, back, CAST(v AS BIGINT) AS v FROM ends WHERE dist[v] > 0 UNION ALL SELECT d, win, back, back[v] FROM way WHERE back[v] > 0)
SELECT n.d AS deployment, n.t, arg_max(n.id, n.ll * 1e9 - n.id) AS id FROM way JOIN n ON way.d = n.d AND way.win = n.win AND way.v = n.v GROUP BY n.d, n.t"""


@query(_TRACK)
def d_track(spark, sf):
    e, targets = _fixes(spark, sf)
    return track.tracks(e, targets)


@query("""WITH e AS (SELECT event_type AS d, event_id AS id, epoch_us(ts) / 1e6 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)
SELECT a.d AS deployment, a.id AS a, b.id AS b FROM e a JOIN e b ON a.d = b.d AND a.t < b.t AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (b.t - a.t) < greatest(0.001, 0.01 + (0.004 - 0.01) * (b.t - a.t - 60) / 1740.0) AND b.t - a.t < 90000""")
def d_feasible_edges(spark, sf):
    e, _ = _fixes(spark, sf)
    rows = e.withColumns({"family": F.lit("linear"), "burst": F.lit(0.01), "sustained": F.lit(0.004), "speed_limit": F.lit(0.001)})
    return track.feasible_edges(rows, ["deployment"], 90_000).select("deployment", "a", "b")


_D = {"width": 8, "save": 24, "rise": 1.4, "tau": 500, "confirm": 4}
#: The detector's table of states, one sample a step; state 0 is below the threshold, 1 near a peak, 2 after one.
_DETECT = f"""WITH RECURSIVE s AS (SELECT event_type AS k, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events WHERE value IS NOT NULL),
m AS (SELECT DISTINCT k, CAST(-1 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS w, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS floor, 0 AS used, 0 AS state, CAST(0 AS DOUBLE) AS best, CAST(0 AS BIGINT) AS best_at, 0 AS waited, false AS pulse FROM s
UNION ALL SELECT k, i, w, level AS total,
CASE WHEN i + 1 = {_D["save"]} THEN level WHEN averaged THEN floor + CAST(1 AS DOUBLE) / CASE WHEN used < {_D["tau"]} THEN used + 1 ELSE {_D["tau"]} END * (level - floor) ELSE floor END,
CASE WHEN i + 1 = {_D["save"]} THEN {_D["width"]} WHEN averaged AND used < {_D["tau"]} THEN used + 1 ELSE used END,
CASE WHEN filling THEN state WHEN state = 0 AND rises THEN 1 WHEN state = 1 AND NOT higher AND waited + 1 >= {_D["confirm"]} THEN 2 WHEN state = 2 AND falls THEN 0 ELSE state END,
CASE WHEN NOT filling AND (state = 0 AND rises OR state = 1 AND higher) THEN level ELSE best END, CASE WHEN NOT filling AND (state = 0 AND rises OR state = 1 AND higher) THEN i ELSE best_at END,
CASE WHEN NOT filling AND (state = 0 AND rises OR state = 1 AND higher) THEN 0 WHEN NOT filling AND state = 1 THEN waited + 1 ELSE waited END,
NOT filling AND state = 1 AND NOT higher AND waited + 1 >= {_D["confirm"]} FROM (
SELECT *, i < {_D["save"]} AS filling, level > CAST({_D["rise"]} AS DOUBLE) * floor AS rises, level > best AS higher, level < CAST(0.9 AS DOUBLE) * CAST({_D["rise"]} AS DOUBLE) * floor AS falls,
i >= {_D["save"]} AND (state = 2 OR state = 0 AND NOT level > CAST({_D["rise"]} AS DOUBLE) * floor) AS averaged FROM (
SELECT k, i, CASE WHEN len(w) >= {_D["width"]} THEN list_append(w[2:], v) ELSE list_append(w, v) END AS w, CASE WHEN len(w) >= {_D["width"]} THEN total + v - w[1] ELSE total + v END AS level, floor, used, state, best, best_at, waited FROM (
SELECT m.k, s.i, m.w, m.total, m.floor, m.used, m.state, m.best, m.best_at, m.waited, CASE WHEN s.i < {_D["save"]} THEN s.x ELSE least(s.x, (2 * CAST({_D["rise"]} AS DOUBLE) - 1) / {_D["width"]} * m.floor) END AS v FROM m JOIN s ON s.k = m.k AND s.i = m.i + 1) a) b) c)
SELECT k AS event_type, best_at AS peak, best AS level, floor, best / floor AS rate FROM m WHERE pulse"""


@query(_DETECT)
def r_detector(spark, sf):
    """Pulses in the event values of each type, taken as one stream in order of id; the batch form of the streaming operator."""
    from fixwave.streaming.detector import detect_ordered

    rows = table(spark, sf, "events").select("event_type", "event_id", "value")
    return detect_ordered(rows, "event_type", "event_id", "value", Detector(pulse_width=_D["width"], save_width=_D["save"], rise=_D["rise"], time_constant=_D["tau"], confirmation=_D["confirm"]))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT max(c_custkey) + 1, 0.0 FROM customer""")
def k_upsert(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = base.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return sinks.upsert(base, new.unionByName(base.agg((F.max("c_custkey") + 1).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))), ["c_custkey"])


@query("""WITH n AS (SELECT user_id, event_id, -value AS value FROM events WHERE event_id BETWEEN 300 AND 600), s AS (SELECT user_id, min(event_id) AS a, max(event_id) AS z FROM n GROUP BY ALL)
SELECT e.user_id, e.event_id, e.value FROM events e LEFT JOIN s ON e.user_id = s.user_id WHERE a IS NULL OR e.event_id < a OR e.event_id > z UNION ALL SELECT * FROM n""")
def k_range_replace(spark, sf):
    base = table(spark, sf, "events").select("user_id", "event_id", "value")
    return sinks.range_replace(base, base.where("event_id between 300 and 600").withColumn("value", -F.col("value")), ["user_id"], "event_id")


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_id > 100)
SELECT lpad(CAST(min(event_id) AS VARCHAR), 16, '0') AS file, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n_rows FROM r GROUP BY i // 1000""")
def k_archive(spark, sf):
    rows = sinks.chunked(table(spark, sf, "events").select("event_id", "value"), "event_id", 100, 1000)
    return rows.groupBy("file").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n_rows"))


@query("""SELECT event_id FROM events WHERE event_id > 777""")
def k_replicate(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return sinks.replicate(e, e.where("event_id <= 777"), "event_id")


@query("""SELECT 'orders' AS obj_table, o_orderkey AS obj_id, 'lineitem' AS dep_table, CAST(l_linenumber AS BIGINT) AS dep_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def k_provenance(spark, sf):
    made = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("deps"))
    return sinks.provenance(made, "orders", "l_orderkey", "lineitem", "deps")


@query()
def k_json(spark, sf):
    return sinks.as_json(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"))


@query("""SELECT n_name AS name, 946684800 + n_nationkey AS t, '<Placemark><name>' || n_name || '</name><TimeStamp><when>' || strftime(TIMESTAMP '2000-01-01' + to_seconds(n_nationkey), '%Y-%m-%dT%H:%M:%SZ') || '</when></TimeStamp><Point><coordinates>' || printf('%.6f,%.6f,%.1f', n_nationkey * 1.5, n_nationkey * 2.5, 0.0) || '</coordinates></Point></Placemark>' AS placemark FROM nation""")
def k_kml(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), (946684800 + F.col("n_nationkey")).alias("t"), (F.col("n_nationkey") * 1.5).alias("lon"), (F.col("n_nationkey") * 2.5).alias("lat"))
    return sinks.kml_points(n, "name", "t", "lon", "lat")
