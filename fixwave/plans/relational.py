"""Queries of filters, joins, aggregates, sorts and sets over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixwave.functions import scalar
from fixwave.operators import aggregates, filters, joins, scoring
from fixwave.operators.joins import small
from fixwave.plans.registry import query, table

THRESHOLDS = [(5.0, 0), (10.0, 1), (25.0, 2), (40.0, 3)]


@query("""SELECT event_id, user_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 80 OR value > 120 THEN -1 END AS score FROM events""")
def f_param_filter(spark, sf):
    e = table(spark, sf, "events")
    band10 = F.get_json_object("props", "$.k").cast("int")
    flag = scoring.parameter_flag(F.col("value"), band10, F.lit(120.0), F.lit(80))
    return e.select("event_id", "user_id", F.when(flag, -1).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / NULLIF(l_linenumber - 1, 0), 4) AS relative FROM lineitem WHERE l_quantity / NULLIF(l_linenumber - 1, 0) >= 9""")
def f_rel_score(spark, sf):
    x = table(spark, sf, "lineitem")
    theory = F.col("l_linenumber") - 1
    return x.where(filters.relative_score(F.col("l_quantity"), theory, 9.0)).select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_quantity", theory), 4).alias("relative"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 40 THEN 3 END AS colour FROM lineitem""")
def f_banding(spark, sf):
    bands = spark.createDataFrame(THRESHOLDS, "level double, colour int")
    return joins.banded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", bands, "level", "colour")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 200000 ORDER BY o_orderkey LIMIT 50 OFFSET 20""")
def f_request(spark, sf):
    return filters.request(table(spark, sf, "orders"), equal={"o_orderstatus": "F"}, between=("o_totalprice", 50000, 200000), fields=["o_orderkey", "o_totalprice"], order=["o_orderkey"], offset=20, limit=50, key="o_orderkey")


@query("""SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events WHERE strftime(ts, '%H:%M') >= '18:00' OR strftime(ts, '%H:%M') <= '07:00' OR strftime(ts, '%H:%M') BETWEEN '12:00' AND '12:30'""")
def f_schedule(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "HH:mm").alias("clock"))
    return e.where(filters.on_schedule(F.lit("18:00-7:00|12:00-12:30"), F.col("clock")))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'owned' WHEN c_nationkey IN (5, 7) THEN 'collaborate' WHEN c_nationkey IN (7, 9) THEN 'view' WHEN c_acctbal > 0 THEN 'public' ELSE 'none' END AS visibility FROM customer""")
def f_visibility(spark, sf):
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("ownerID"), (F.col("c_acctbal") > 0).alias("is_public"))
    member = lambda keys: projects.where(F.col("ownerID").isin(keys)).select(F.col("ID").alias("projectID"), F.lit(1).alias("groupID"))
    return filters.visibility(projects, 3, [1], member([7, 9]), member([5, 7])).select(F.col("ID").alias("c_custkey"), "visibility")


@query("""WITH f AS (SELECT user_id, epoch_us(ts) AS t, event_id, value, CASE WHEN value < 10 THEN 0 WHEN value > 60 THEN 1 END AS f FROM events)
SELECT event_id, last_value(f IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) = 1 AS powered FROM f""")
def f_hysteresis(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", scalar.micros(F.col("ts")).alias("t"), "value")
    return filters.hysteresis(e, ["user_id"], ["t", "event_id"], "value", 10.0, 60.0).select("event_id", "powered")


@query("""SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity >= 40""")
def j_inner_est_score(spark, sf):
    items = table(spark, sf, "lineitem").where("l_quantity >= 40")
    return table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "l_linenumber", "l_quantity")


@query("""SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def j_left_unscored(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))  # counted before the join
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)""")
def j_semi_in(spark, sf):
    items = table(spark, sf, "lineitem").where("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(items, "o_orderkey", "left_semi")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0)""")
def j_anti_missing(spark, sf):
    return joins.missing(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY r_name, n_name""")
def j_four_way(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    nations = small(table(spark, sf, "nation").join(small(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@query("""SELECT e.event_id, n.n_nationkey AS site FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id""")
def j_lookup_rejects(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("name"))
    found, rejects = joins.lookup(e, table(spark, sf, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_nationkey").alias("site")), "name", "site")
    return found.select("event_id", "site").unionByName(rejects.select("event_id"), allowMissingColumns=True)


@query("""SELECT event_type, arg_max(value, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS value, max(epoch_us(ts)) AS t FROM events GROUP BY event_type""")
def j_last_value(spark, sf):
    e = table(spark, sf, "events").withColumn("t", scalar.micros(F.col("ts"))).withColumn("at", F.struct("t", "event_id"))
    return joins.last_values(e, ["event_type"], "at", ["value", "t"])


@query("""WITH l AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events WHERE event_id % 2 = 0),
r0 AS (SELECT event_type, epoch_us(ts) AS t, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
a AS (SELECT l.*, r.t AS ta, r.v AS va FROM l ASOF JOIN r0 r ON l.event_type = r.event_type AND l.t >= r.t),
b AS (SELECT a.*, r.t AS tb, r.v AS vb FROM a ASOF JOIN r0 r ON a.event_type = r.event_type AND a.t <= r.t)
SELECT event_id, round(CASE WHEN tb = ta THEN va ELSE va + (t - ta) / CAST(tb - ta AS DOUBLE) * (vb - va) END, 6) AS v FROM b""")
def j_asof_interp(spark, sf):
    e = table(spark, sf, "events").withColumn("t", scalar.micros(F.col("ts")))
    left = e.where("event_id % 2 = 0").select("event_id", "event_type", "t")
    right = e.where("event_id % 2 = 1").select("event_type", "t", F.col("value").alias("v"))
    return joins.asof_linear(left, right, ["event_type"], "t", ["v"]).select("event_id", F.round("v", 6).alias("v"))


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events)
SELECT a.event_id AS first, b.event_id AS second, b.t - a.t AS gap FROM e a JOIN e b ON a.event_type = b.event_type AND b.t - a.t > 600000000 AND b.t - a.t < 3600000000""")
def j_range_pairs(spark, sf):
    e = table(spark, sf, "events").withColumn("t", scalar.micros(F.col("ts")))
    pairs = joins.range_pairs(e, ["event_type"], "t", 600_000_000, 3_600_000_000, ["event_id"])
    return pairs.select(F.col("event_id_1").alias("first"), F.col("event_id_2").alias("second"), (F.col("t_2") - F.col("t_1")).alias("gap"))


@query("""WITH e AS (SELECT event_id, event_type, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t FROM events), b AS (SELECT event_type, min(t) AS a, max(t) AS z FROM e GROUP BY event_type),
c AS (SELECT event_type, unnest(generate_series(CAST(ceil(floor(a + 10800.0) / 3600) AS BIGINT), CAST(floor(floor(z - 10800.0) / 3600) AS BIGINT))) * 3600 AS centre FROM b)
SELECT e.event_type, centre, count(*) AS n FROM e JOIN c ON e.event_type = c.event_type AND e.t >= centre - 10800 AND e.t < centre + 10800 GROUP BY ALL""")
def j_window_interval(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(scalar.micros(F.col("ts")) / 1000000).alias("t"))
    return joins.interval_join(e, ["event_type"], "t", 3600, 21600).groupBy("event_type", "centre").agg(F.count("*").alias("n"))


@query("""SELECT a.c_custkey AS k_1, b.c_custkey AS k_2 FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey AND sqrt((a.c_acctbal - b.c_acctbal) ** 2 + (a.c_nationkey * 10.0 - b.c_nationkey * 10.0) ** 2) <= 12.0""")
def j_near_pairs(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 10.0).alias("y"))
    return joins.near_pairs(c, "c_custkey", "x", "y", 12.0).select("k_1", "k_2")


@query("""SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey""")
def j_combinations(spark, sf):
    return joins.combinations(table(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", repeat=True)


@query("""SELECT event_type, user_id % 10 AS deployment, round(avg(value) + 1e-7, 3) AS avg_value, count(*) AS n, count_if(value > 50) AS n_good FROM events GROUP BY ALL""")
def a_dashboard(spark, sf):
    e = table(spark, sf, "events").withColumn("deployment", F.col("user_id") % 10)
    return e.groupBy("event_type", "deployment").agg(F.round(F.avg("value") + 1e-7, 3).alias("avg_value"), F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_good"))


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 3) AS avg_l_quantity, round(avg(l_discount), 3) AS avg_l_discount FROM lineitem GROUP BY ALL""")
def a_averages(spark, sf):
    return aggregates.averages(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])


@query("""SELECT o_orderpriority, round(sum(o_totalprice) / NULLIF(sum(o_orderkey), 0), 6) AS rate FROM orders GROUP BY ALL""")
def a_rate(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(aggregates.rate(F.col("o_totalprice"), F.col("o_orderkey")), 6).alias("rate"))


@query("""SELECT 'score' AS name, max(event_id) AS top, 100 AS at, max(event_id) - 100 AS backlog FROM events""")
def a_backlog(spark, sf):
    return aggregates.backlog(table(spark, sf, "events"), "event_id", spark.createDataFrame([("score", 100)], "name string, value long"), "score")


@query("""WITH b AS (SELECT event_type, min(value) AS low, max(value) AS high, CAST(1 + floor((max(value) - min(value)) / 2.0) AS BIGINT) AS bins FROM events GROUP BY ALL),
h AS (SELECT event_type, least(CAST(floor((value - low) * bins / NULLIF(high - low, 0)) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM events JOIN b USING (event_type) GROUP BY ALL)
SELECT * FROM h""")
def a_hist_interval(spark, sf):
    return aggregates.equal_bins(table(spark, sf, "events"), ["event_type"], "value", 2.0).select("event_type", "bin", "n")


@query("""WITH b AS (SELECT event_type, min(value) AS low, max(value) AS high, CAST(1 + floor((max(value) - min(value)) / 2.0) AS BIGINT) AS bins FROM events GROUP BY ALL),
h AS (SELECT event_type, low, high, bins, least(CAST(floor((value - low) * bins / NULLIF(high - low, 0)) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM events JOIN b USING (event_type) GROUP BY ALL),
m AS (SELECT *, floor(low + (bin + 0.5) * ((high - low) / bins)) AS mid, max(n) OVER (PARTITION BY event_type) AS most FROM h),
x AS (SELECT event_type, arg_max(mid, n * 100000 - bin) AS mode FROM m GROUP BY ALL)
SELECT event_type, CAST(mode AS BIGINT) AS mode, round(sum(CASE WHEN bin < bins - 1 THEN 0.02 * n / most * (mid - mode) ** 2 ELSE 0 END), 5) AS moment, CAST(sum(n) AS BIGINT) AS n FROM m JOIN x USING (event_type) GROUP BY event_type, mode""")
def a_mode_moment(spark, sf):
    h = aggregates.equal_bins(table(spark, sf, "events"), ["event_type"], "value", 2.0)
    return aggregates.mode_and_moment(h, ["event_type"]).select("event_type", F.col("mode").cast("long").alias("mode"), F.round("moment", 5).alias("moment"), "n")


@query("""SELECT event_type, round(sqrt(var_pop(value) * count(value)) / sum(value), 6) AS activity FROM events GROUP BY ALL""")
def a_activity(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(aggregates.activity(F.col("value")), 6).alias("activity"))


@query("""WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), s AS (SELECT label, i, sum(CAST(v AS DOUBLE)) AS s FROM x GROUP BY ALL)
SELECT label, CAST(arg_max(i, s) AS INT) AS best, round(max(s), 4) AS top FROM s GROUP BY label""")
def a_vector_sum_argmax(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    s = aggregates.vector_sum(e, ["label"], "embedding", "s")
    return s.select("label", aggregates.argmax(F.col("s")).alias("best"), F.round(F.array_max("s"), 4).alias("top"))


@query("""SELECT l_returnflag, round(var_samp(l_quantity), 4) AS c11, round(covar_samp(l_quantity, l_discount), 6) AS c12, round(var_samp(l_discount), 8) AS c22 FROM lineitem GROUP BY ALL""")
def a_cov2x2(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.var_samp("l_quantity"), 4).alias("c11"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("c12"), F.round(F.var_samp("l_discount"), 8).alias("c22"))


@query("""SELECT user_id, list_sort(list(value))[CAST(least(floor(count(*) * 0.9), count(*) - 1) AS BIGINT) + 1] AS w90 FROM events GROUP BY ALL""")
def a_order_stat(spark, sf):
    return aggregates.order_statistic(table(spark, sf, "events"), ["user_id"], "value", 0.9, "w90")


@query("""SELECT label, round(sum(CAST(embedding[1] AS DOUBLE) * embedding[3] + CAST(embedding[2] AS DOUBLE) * embedding[4]), 4) AS g12r, round(sum(CAST(embedding[2] AS DOUBLE) * embedding[3] - CAST(embedding[1] AS DOUBLE) * embedding[4]), 4) AS g12i FROM embeddings GROUP BY ALL""")
def a_gram(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    g = e.groupBy("label").agg(*aggregates.gram_matrix([F.col("v")[0], F.col("v")[2]], [F.col("v")[1], F.col("v")[3]]))
    return g.select("label", F.round("g12r", 4).alias("g12r"), F.round("g12i", 4).alias("g12i"))


@query("""SELECT a.c_custkey, 5 + 2 * count(b.c_custkey) AS density FROM customer a LEFT JOIN customer b ON a.c_custkey <> b.c_custkey AND sqrt((a.c_acctbal - b.c_acctbal) ** 2 + (a.c_nationkey * 10.0 - b.c_nationkey * 10.0) ** 2) <= 12.0 GROUP BY a.c_custkey""")
def a_density(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 10.0).alias("y"))
    return aggregates.density(c, "c_custkey", "x", "y", 12.0).select("c_custkey", "density")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 1000000 AS t, value FROM events), b AS (SELECT event_type, min(t) AS a, max(t) AS z, CASE WHEN (max(t) - min(t)) / 100.0 > 20000 THEN CAST(ceil((max(t) - min(t)) / 20000.0) AS BIGINT) ELSE 100 END AS k FROM e GROUP BY ALL),
p AS (SELECT e.*, (t - a) / least((z - a) / 100.0, 20000.0) AS p, k FROM e JOIN b USING (event_type)),
x AS (SELECT event_type, value, CAST(floor(p) AS BIGINT) AS bin FROM p WHERE p < k UNION ALL SELECT event_type, value, CAST(floor(p) AS BIGINT) - 1 FROM p WHERE p = floor(p) AND p > 0)
SELECT event_type, bin, round(avg(value), 6) AS mean_value, count(*) AS n FROM x GROUP BY ALL""")
def a_mean_resample(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(scalar.micros(F.col("ts")) / 1000000).alias("t"), "value")
    return aggregates.mean_resample(e, ["event_type"], "t", ["value"], 100, 20_000.0).select("event_type", "bin", F.round(F.col("mean_value"), 6).alias("mean_value"), "n")


@query("""SELECT count_if(s IS NULL) AS unscored, count_if(t = 0) AS no_interval, count_if(s < 0) AS bad, count_if(s = 0) AS zero, count_if(s > 0) AS positive FROM (SELECT CASE WHEN value > 30 THEN event_id % 5 - 1 END AS s, user_id % 3 AS t FROM events)""")
def a_score_breakdown(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(*aggregates.score_breakdown(F.when(F.col("value") > 30, F.col("event_id") % 5 - 1), F.col("user_id") % 3))


@query("""SELECT b, count(*) AS n FROM (SELECT CASE WHEN l_quantity = 50 THEN 19 WHEN l_quantity >= 0 AND l_quantity < 50 THEN CAST(floor(l_quantity / 50 * 20) AS INT) END AS b FROM lineitem) GROUP BY b""")
def a_hist_relscore(spark, sf):
    return table(spark, sf, "lineitem").select(aggregates.bin_of(F.col("l_quantity"), 0, 50, 20).alias("b")).groupBy("b").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT o_custkey, o_orderstatus FROM orders""")
def a_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def t_last_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 250""")
def t_keyset(spark, sf):
    from fixwave.streaming.batches import next_batch

    return next_batch(table(spark, sf, "events").select("event_id"), "event_id", 500, 250)


@query("""SELECT c_custkey AS k, c_acctbal AS a, CAST(NULL AS DOUBLE) AS b FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""")
def u_union_missing(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b")), allowMissingColumns=True)


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def u_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def u_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT user_id, arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS event_type FROM events GROUP BY user_id""")
def u_dedupe_last(spark, sf):
    at = F.struct(scalar.micros(F.col("ts")).alias("t"), "event_id")
    return joins.last_values(table(spark, sf, "events").withColumn("at", at), ["user_id"], "at", ["event_type"])
