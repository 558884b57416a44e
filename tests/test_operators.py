"""Operators on small fixtures: numeric cases, properties, round trips."""

import numpy as np

import pytest
from pyspark.sql import functions as F

from fixwave.config import Detector, Positioning, Scoring, Tracking
from fixwave.functions import geo
from fixwave.operators import aggregates, direction, features, filters, joins, pieces, position, scoring, track, windows
from fixwave.plans import domain
from fixwave.plans.domain import simulated
from fixwave.sources import det, sinks, tables
from fixwave.streaming import batches, detector


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pulses(spark, times):
    return spark.createDataFrame([(k, 1, 1, int(t), 0, 0) for k, t in enumerate(times)], "id long, deployment int, site int, t long, band3 int, band10 int")


def test_perfect_train_scores(spark):
    base = 60_000 * 1000
    out, intervals = scoring.score(pulses(spark, [base + 1000 * k + 5 for k in range(60)]), 60.0)
    got = {r["id"]: (r["score"], r["theoretical_score"]) for r in out.collect()}
    assert {r["pulse_interval"] for r in intervals.where(F.col("interval") == base).collect()} == {1000}
    assert got[30] == (18, 20) and got[0] == (9, 20)


def test_two_pulses_in_a_bin_score_nothing(spark):
    base = 60_000 * 1000
    out, _ = scoring.score(pulses(spark, [base + 1000 * k for k in range(30)] + [base + 10_010]), 60.0)
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got[10] == 0 and got[30] == 0 and got[11] > 0


def test_few_gaps_give_no_interval(spark):
    out, _ = scoring.score(pulses(spark, [60_000_000, 60_001_000]), 60.0)
    assert {(r["score"], r["theoretical_score"]) for r in out.collect()} == {(0, 0)}


def test_bursts_and_limits_are_flagged(spark):
    base = 60_000 * 1000
    out, _ = scoring.score(pulses(spark, [base + 10 * k for k in range(600)]), 60.0)
    assert {r["score"] for r in out.collect()} == {-2}
    limits = spark.createDataFrame([(1, -1, None)], "deployment int, limit3 int, limit10 int")
    out, _ = scoring.score(pulses(spark, [base, base + 1000]), 60.0, limits)
    assert {r["score"] for r in out.collect()} == {-1}


def test_sessions_break_at_twice_the_margin(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 119, 239, 360)], "k string, t long")
    assert sorted((r["first"], r["last"], r["n"]) for r in windows.sessions(df, ["k"], "t", 60).collect()) == [(-60, 179, 2), (179, 299, 1), (300, 420, 1)]


def test_counts_ahead_read_no_frame_again(spark, capsys):
    rng = np.random.default_rng(4)
    data = [(k, None if k % 5 == 0 else "ab"[k % 2], None if k % 11 == 0 else float(t) / 4) for k, t in enumerate(rng.integers(-90, 200, 400))]
    got = windows.ahead(spark.createDataFrame(data, "id long, g string, t double").repartition(5), ["g"], "t", 7)
    for r in got.collect():
        like = [t for _, g, t in data if g == r.g]
        assert r.n_ahead == (sum(t is None for t in like) if r.t is None else sum(t is not None and r.t <= t <= r.t + 7 for t in like))
    assert got.columns == ["id", "g", "t", "n_ahead"] and got.count() == 400
    got.explain()
    frames = capsys.readouterr().out.split("specifiedwindowframe(")[1:]
    assert frames and all("unboundedpreceding$()" in f.split(")")[0] + ")" for f in frames)


def test_row_windows_cover_and_overlap(spark):
    df = spark.createDataFrame([("a", t, t) for t in range(1234)], "k string, t long, id long")
    w = windows.row_windows(df, ["k"], "t", 500, 100, "id").groupBy("window_id").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).orderBy("window_id").collect()
    assert w[0]["a"] == 0 and w[-1]["z"] == 1233 and w[-1]["n"] >= 500
    assert all(x["z"] - y["a"] + 1 >= 100 for x, y in zip(w, w[1:]))


def test_windows_are_half_open(spark):
    df = spark.createDataFrame([("a", t) for t in range(0, 201)], "k string, t long")
    got = joins.interval_join(df, ["k"], "t", 60, 30).groupBy("centre").agg(F.min("t"), F.max("t")).orderBy("centre").collect()
    assert [tuple(r) for r in got] == [(60, 45, 74), (120, 105, 134), (180, 165, 194)]


def test_asof_drops_what_is_outside_and_ignores_order(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 10, 15, 20, 30)], "k string, t long")
    right = spark.createDataFrame([("a", 20, 4.0), ("a", 10, 2.0)], "k string, t long, v double")
    got = joins.asof_linear(left, right, ["k"], "t", ["v"])
    assert rows(got.select("t", "v")) == [(10, 2.0), (15, 3.0), (20, 4.0)]


def test_utm_round_trip_and_zone(spark):
    df = spark.createDataFrame([(37.98, -78.5), (-33.9, 151.2), (0.0, 3.0)], "lat double, lon double")
    e, n, z = geo.to_utm(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_utm(e, n, z, F.col("lat") < 0)
    for r in df.select("lat", "lon", e.alias("e"), lat.alias("la"), lon.alias("lo"), z.alias("z")).collect():
        assert abs(r["lat"] - r["la"]) < 1e-8 and abs(r["lon"] - r["lo"]) < 1e-8
        assert r["lon"] != 3.0 or (abs(r["e"] - 500000) < 1e-6 and r["z"] == 31)


def test_geodesic(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (10.0, 10.0, 10.0, 10.0)], "a double, b double, c double, d double")
    got = df.select(geo.geodesic("a", "b", "c", "d").alias("g")).select("g.*").collect()
    assert abs(got[0]["metres"] - 111319.4908) < 1e-3 and abs(got[0]["azimuth1"] - 90) < 1e-9 and tuple(got[1]) == (0.0, 0.0, 0.0)


def test_speed_families(spark):
    df = spark.createDataFrame([(f, float(t)) for f in ("const", "linear", "exp") for t in (60, 1800)], "f string, t double")
    got = {(r["f"], r["t"]): r["m"] for r in df.select("f", "t", geo.max_speed(F.col("f"), F.lit(20.0), F.lit(8.0), F.lit(2.0), F.col("t")).alias("m")).collect()}
    assert got[("const", 60.0)] == 2 and abs(got[("linear", 60.0)] - 20) < 1e-9 and abs(got[("exp", 1800.0)] - 8) < 1e-9
    with pytest.raises(Exception, match="unknown speed family"):
        df.select(geo.max_speed(F.lit("warp"), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.col("t"))).collect()


def test_spline_meets_its_knots_and_is_smooth():
    k = np.sin(np.radians(np.arange(360))) ** 2
    assert np.allclose(position.spline(k, np.arange(-360.0, 360.0)), np.tile(k, 2))
    x = np.linspace(0, 360, 5000)
    assert np.abs(position.spline(k, x) - np.sin(np.radians(x)) ** 2).max() < 1e-7


def test_simulated_position_is_found(spark):
    sites, vectors, signal = simulated(spark, seconds=100)
    cfg = Positioning(coarse_m=25.0, fine_m=1.0)
    sums = position.bearings(signal, direction.packed_steering(vectors), cfg)
    p = position.positions(sums, sites, 200.0, cfg).collect()[0]
    assert abs(p["easting"] - 200) <= 15 and abs(p["northing"] - 300) <= 15 and p["n_sites"] == 3
    assert position.positions(sums.where("site = 0"), sites, 200.0, cfg).count() == 0


def test_calibration_recovers_vectors(spark):
    _, vectors, _ = simulated(spark)
    samples = vectors.select("site", F.col("bearing").cast("double").alias("bearing"), *[F.col(f"sv{c}{p}").alias(f"ed{c}{p}") for c in range(1, 5) for p in "ri"])
    fitted = direction.calibrate(samples, 1)
    assert direction.verified(samples, fitted).agg(F.max("error")).first()[0] <= 1.0


def test_mle_finds_the_same_bearing():
    rng = np.random.default_rng(1)
    g = rng.normal(size=(360, 4)) + 1j * rng.normal(size=(360, 4))
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    v = g[[17, 200]]
    for method in direction.METHODS:
        s = direction.spectrum_batch(method, v, g, np.stack([np.eye(4) * 1e-3] * 2), np.ones(2))
        assert s.shape == (2, 360) and (method == "mle" or s.argmax(axis=1).tolist() == [17, 200])


def test_track_avoids_an_impossible_jump(spark):
    points = spark.createDataFrame([(1, k, float(60 * k), 10.0 * k, 0.0, 1.0) for k in range(6)] + [(1, 9, 120.0, 99999.0, 0.0, 5.0)], "deployment int, id int, t double, easting double, northing double, likelihood double")
    targets = spark.createDataFrame([(1, "const", 1.0, 1.0, 1.0)], "deployment int, family string, burst double, sustained double, speed_limit double")
    got = [r["id"] for r in track.tracks(points, targets).orderBy("t").collect()]
    assert got == [0, 1, 2, 3, 4, 5]


def test_edges_within_a_time_meet_in_its_buckets(spark, capsys):
    rows = [(k % 2, k, 37.0 * k - 900, float(k % 7), float(k % 5), 1.0, "linear", 1.0, 0.5, 0.1) for k in range(90)]
    points = spark.createDataFrame(rows, "deployment int, id long, t double, easting double, northing double, likelihood double, family string, burst double, sustained double, speed_limit double")
    near, every = track.feasible_edges(points, ["deployment"], 370.0), track.feasible_edges(points, ["deployment"])
    want = sorted(tuple(r) for r in every.where("t_b - t_a < 370").collect())
    assert sorted(tuple(r) for r in near.collect()) == want and 90 < len(want) < every.count()
    near.explain()
    assert "[deployment#" in (join := capsys.readouterr().out.split("Join", 1)[1].split("\n")[0]) and join.count("__b#") == 2


@pytest.mark.parametrize("pairs", [joins.TASK_PAIRS, 60])
def test_pairs_are_dealt_over_tasks_by_their_number(spark, monkeypatch, capsys, pairs):
    monkeypatch.setattr(joins, "TASK_PAIRS", pairs)
    one = spark.createDataFrame([(k, "b" if k < 3 else "a" if k < 40 else None) for k in range(45)], "x long, g string")
    two = spark.createDataFrame([(k, "b" if k < 2 else "a" if k < 22 else None) for k in range(25)], "y long, g string")
    got = joins.meeting(one, two, ["g"])
    assert got.columns == ["g", "x", "y"] and rows(got) == rows(one.join(two, "g")) and got.count() == 3 * 2 + 37 * 20
    joins.meeting(one, two, ["g"]).explain()
    plan = capsys.readouterr().out
    assert pairs > 60 or (plan.count(", 13), REPARTITION_BY_NUM") == 2 and "SortMergeJoin [g#" in plan)  # 746 pairs


def test_roots_are_found_without_edges(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 400)
    rng = np.random.default_rng(8)
    data = [(int(d), k, float(t), None if k % 40 == 0 else float(x), float(y), 1.0, "linear", 1.0, 0.5, 0.1) for k, (d, t, x, y) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(-2000, 2000, 300), rng.exponential(400, 300), rng.uniform(0, 40, 300)))]
    points = spark.createDataFrame(data, "deployment int, id long, t double, easting double, northing double, likelihood double, family string, burst double, sustained double, speed_limit double").repartition(3)
    edges = track.feasible_edges(points, ["deployment"]).where("t_b - t_a < 370")
    want = rows(track.roots(points, edges, ["deployment"]))
    assert rows(track.unreached(points, ["deployment"], 370.0)) == want and 10 < len(want) < 290
    assert track.unreached(points.limit(0), ["deployment"], 370.0).count() == 0


def test_queries_of_pairs_are_the_same_when_dealt(spark, sf, monkeypatch):
    from fixwave import registry

    for name in ("d_feasible_edges", "j_range_pairs", "j_near_pairs", "a_density"):
        plain = rows(registry.queries()[name](spark, sf))
        with monkeypatch.context() as m:
            m.setattr(joins, "TASK_PAIRS", 40)
            dealt = registry.queries()[name](spark, sf)
            assert rows(dealt) == plain and (name == "a_density" or dealt.rdd.getNumPartitions() > 4)


def _bursts(spark):
    rng = np.random.default_rng(5)
    times = [int(t) for t in [*rng.integers(-4000, 4000, 120), *np.repeat(rng.integers(0, 90, 10), 12), *rng.integers(1000, 1060, 60)]]
    data = [(k, "ab"[k % 2], t) for k, t in enumerate(times)] + [(900, None, 5), (901, "a", None), (902, "c", 7)]
    df = spark.createDataFrame(data, "k long, g string, at long").repartition(3)
    want = sorted((g, a, s, b, t) for a, g, s in data for b, h, t in data if g and g == h and s is not None and t is not None and 70 < t - s < 400)
    return df, want


@pytest.mark.parametrize("pairs, most", [(40, 5), (40, 1000), (2000, 7), (20_000, 30), (10**9, 1000)])
def test_range_pairs_meet_once_however_they_are_dealt(spark, monkeypatch, pairs, most):
    monkeypatch.setattr(joins, "TASK_PAIRS", pairs)
    monkeypatch.setattr(joins, "GATHERED", most)
    df, want = _bursts(spark)
    got = joins.range_pairs(df, ["g"], "at", 70, 400, ["k"])
    assert got.columns == ["g", "k_1", "t_1", "k_2", "t_2"]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 1000
    bare = joins.range_pairs(df, ["g"], "at", 70, 400, [])
    assert sorted(tuple(r) for r in bare.collect()) == sorted((g, s, t) for g, _, s, _, t in want)


def test_range_pairs_shuffle_rows_once_not_for_each_bucket(spark, monkeypatch, capsys):
    monkeypatch.setattr(joins, "TASK_PAIRS", 40_000)
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("at"), F.expr("id < 0").alias("g"))
    seen = []
    plain = joins._stretches
    monkeypatch.setattr(joins, "_stretches", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = joins.range_pairs(df, ["g"], "at", 70, 400, ["k"])
    got.explain()
    assert capsys.readouterr().out.count("Exchange") == 1  # a join shuffles both sides
    assert seen[0][0].count() <= 2 * 4000  # a join on buckets has 9 copies of a row
    rows = got.collect()
    assert len(rows) == sum(4000 - d for d in range(8, 40))
    places = [(r.t_1, r.t_2) for r in rows]
    assert sum(a[0] != b[0] for a, b in zip(places, places[1:])) < 4000 * 9  # an earlier row's pairs are together


def test_feasible_edges_shuffle_points_once_not_for_each_bucket(spark, monkeypatch, capsys):
    monkeypatch.setattr(joins, "TASK_PAIRS", 40_000)
    rng = np.random.default_rng(11)
    data = [(k % 2, k, k * 10.0, None if k % 50 == 0 else float(x), float(y), 1.0, "linear", 1.0, 0.5, 0.1) for k, (x, y) in enumerate(zip(rng.exponential(100, 1500), rng.uniform(0, 40, 1500)))]
    points = spark.createDataFrame(data, "deployment int, id long, t double, easting double, northing double, likelihood double, family string, burst double, sustained double, speed_limit double").repartition(3)
    seen = []
    plain = joins._stretches
    monkeypatch.setattr(joins, "_stretches", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = track.feasible_edges(points, ["deployment"], 370.0)
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1  # a join shuffles both sides
    assert seen[0][0].count() <= 2 * 1500  # a join on buckets has 10 copies of a point
    want = track.feasible_edges(points, ["deployment"]).where("t_b - t_a < 370")
    assert got.columns == want.columns and rows(got) == rows(want) and want.count() > 1000


def test_range_pairs_keep_columns_of_one_side(spark, monkeypatch):
    df, want = _bursts(spark)
    df = df.withColumn("x", F.col("k") * 2).withColumn("y", F.col("k") * 3)
    for pairs in (40, 10**9):
        monkeypatch.setattr(joins, "TASK_PAIRS", pairs)
        got = joins.range_pairs(df, ["g"], "at", 70, 400, ["k"], ["x"], ["y", "x"])
        assert got.columns == ["g", "k_1", "x_1", "t_1", "k_2", "y_2", "x_2", "t_2"]
        assert sorted(tuple(r) for r in got.collect()) == [(g, a, 2 * a, s, b, 3 * b, 2 * b, t) for g, a, s, b, t in want]


def _dense(spark):
    rng = np.random.default_rng(3)
    data = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 30, (200, 2)))]
    return data, spark.createDataFrame(data, "k long, x double, y double")


def test_near_pairs_of_crowded_cells_meet_in_blocks(spark, monkeypatch, capsys):
    data, df = _dense(spark)
    monkeypatch.setattr(joins, "TASK_PAIRS", 400)
    got = joins.near_pairs(df, "k", "x", "y", 5.0)
    assert {(r.k_1, r.k_2) for r in got.collect()} == (want := {(a, b) for a, x, y in data for b, u, v in data if a != b and np.hypot(x - u, y - v) <= 5})
    assert got.count() == len(want)
    joins.near_pairs(df, "k", "x", "y", 5.0).explain()
    assert "__i#" in (plan := capsys.readouterr().out) and "REPARTITION_BY_NUM" in plan


def test_density_of_crowded_cells_is_counted_in_blocks(spark, monkeypatch, capsys):
    data, df = _dense(spark)
    monkeypatch.setattr(joins, "TASK_PAIRS", 400)
    got = aggregates.density(df, "k", "x", "y", 5.0)
    assert {r.k: r.density for r in got.collect()} == {a: 5 + 2 * sum(a != b and np.hypot(x - u, y - v) <= 5 for b, u, v in data) for a, x, y in data}
    aggregates.density(df, "k", "x", "y", 5.0).explain()
    assert "__i#" in (plan := capsys.readouterr().out) and "REPARTITION_BY_NUM" in plan


def _copies(spark):
    rng = np.random.default_rng(4)
    places = [(float(p // 30), float(p % 30)) for p in rng.permutation(900)[:30]]
    data = [(k, *places[k % 30]) for k in range(600)] + [(600, None, 1.0), (601, None, 1.0), (602, float("nan"), 2.0), (603, 5.5, 5.5)]
    return data, spark.createDataFrame(data, "k long, x double, y double").repartition(3)


def _met(monkeypatch):
    seen = []
    plain = joins.meeting
    monkeypatch.setattr(joins, "meeting", lambda one, two, *rest: seen.append(two) or plain(one, two, *rest))
    return seen


def test_density_meets_places_not_their_copies(spark, monkeypatch):
    data, df = _copies(spark)
    seen = _met(monkeypatch)
    want = {a: 5 + 2 * sum(x is not None and u is not None and a != b and np.hypot(x - u, y - v) <= 5 for b, u, v in data) for a, x, y in data}
    got = [tuple(r) for r in aggregates.density(df, "k", "x", "y", 5.0).select("k", "density").collect()]
    assert sorted(got) == sorted(want.items()) and seen[-1].count() == 31  # not 601
    twice = df.where("k < 600").withColumn("k", F.expr("k div 2"))  # keys found twice: the plain count
    count = aggregates.density(twice, "k", "x", "y", 5.0).select("k", "density").distinct()
    assert {r.k: r.density for r in count.collect()} == {k: 5 + 2 * sum(np.hypot(x - u, y - v) <= 5 for a, x, y in data[:600] for b, u, v in data[:600] if a // 2 == k and b // 2 != k) for k in range(300)}


def test_near_pairs_meet_places_in_arrays_of_bounded_size(spark, monkeypatch):
    data, df = _copies(spark)
    monkeypatch.setattr(joins, "GATHERED", 7)
    monkeypatch.setattr(joins, "TASK_PAIRS", 4000)
    seen = _met(monkeypatch)
    got = joins.near_pairs(df, "k", "x", "y", 5.0)
    want = [(a, b) for a, x, y in data for b, u, v in data if x is not None and u is not None and a != b and np.hypot(x - u, y - v) <= 5]
    assert sorted((r.k_1, r.k_2) for r in got.collect()) == sorted(want) and got.columns == ["k_1", "x_1", "y_1", "k_2", "x_2", "y_2"]
    at = {d[0]: d[1:] for d in data}
    assert all((r.x_1, r.y_1) == at[r.k_1] and (r.x_2, r.y_2) == at[r.k_2] for r in got.collect())
    sizes = [len(r[0]) for r in seen[-1].select("__rows_2").collect()]
    assert sum(sizes) == 601 and 60 < len(sizes) < 300 and max(sizes) <= 20


@pytest.mark.parametrize("ranges", [2, 5, 16, 37])
def test_ranges_are_found_by_halving(spark, capsys, ranges):
    rng = np.random.default_rng(ranges)
    keys = [(None if k % 50 == 0 else int(rng.integers(0, 4)), [float("nan"), -0.0, 0.0, float(rng.integers(-9, 40))][min(k % 25, 3)], k % 3) for k in range(400)]
    cut = pieces.split(spark.createDataFrame(keys, "a int, b double, c int").repartition(3), ["a", "b", "c"], ranges)
    of = [(r.a, r.b, r.c, r["__piece"]) for r in cut.orderBy("a", "b", "c").collect()]
    numbers = [r[3] for r in of]
    assert len(of) == 400 and numbers == sorted(numbers) and numbers[0] == 0 and ranges * 0.6 < len(set(numbers)) <= ranges
    assert len({(str(a), str((b or 0) + 0.0), c, n) for a, b, c, n in of}) == len({(str(a), str((b or 0) + 0.0), c) for a, b, c, _ in of})
    cut.explain()
    assert "lambda" not in (plan := capsys.readouterr().out) and 1 <= plan.count("CASE WHEN") <= ranges.bit_length()


def test_track_query_takes_the_usual_windows(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(track, "tracks", lambda points, targets, cfg=Tracking(): seen.append(cfg))
    domain.d_track(spark, sf)
    assert seen == [Tracking()] and (seen[0].window, seen[0].overlap) == (500, 100)


def test_critical_path_of_nothing_positive_is_empty():
    assert track.critical_path(np.arange(2), np.arange(2.0), np.array([-1.0, 0.0]), {1: [0]}) == []


def test_det_round_trip_and_quarantine(spark, tmp_path):
    rng = np.random.default_rng(2)
    noise = (rng.normal(size=(400, 4)) + 1j * rng.normal(size=(400, 4))) * 0.01
    tone = np.exp(2j * np.pi * 0.125 * np.arange(160))[:, None] * np.array([1, 1j, -1, 0.5])
    noise[240:400] += tone
    body = noise.astype(np.complex64).tobytes()
    df = spark.createDataFrame([("north", "ID12", 1_300_000_000.25, 4, 240, 160, 8000.0, 150e6, bytearray(body))], "site string, tag string, timestamp double, channels int, pulse_at int, pulse_n int, rate double, center double, samples binary")
    assert det.write(df, str(tmp_path / "d")) == 1
    bad = tmp_path / "d/north/2011/03/13/07/06/X_00000000.det"
    bad.parent.mkdir(parents=True, exist_ok=True)
    bad.write_bytes(b"\0" * 40)
    good, wrong = det.split(det.read(spark, str(tmp_path / "d")))
    r = good.collect()[0]
    assert (r["site"], r["tag"], r["timestamp"], bytes(r["samples"])) == ("north", "ID12", 1_300_000_000.25, body)
    assert wrong.collect()[0]["error"] == "no channels"
    f = features.features(det.read(spark, str(tmp_path / "d"))).collect()[0]
    assert f["deployment"] == 12 and abs(f["frequency"] - 150_001_000) <= 50 and f["ec"] > 0.99 and f["edsnr"] > 20
    assert rows(det.census(spark, str(tmp_path / "d"))) == [("north", 2)]


def test_upsert_and_range_replace_are_idempotent(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 9, "c"), (2, 2, "d")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 1, "x"), (1, 3, "y")], "k int, t int, v string")
    once = sinks.upsert(base, new, ["k", "t"])
    assert rows(once) == rows(sinks.upsert(once, new, ["k", "t"])) and once.count() == 5
    swapped = sinks.range_replace(base, new, ["k"], "t")
    assert rows(swapped) == [(1, 1, "x"), (1, 3, "y"), (1, 9, "c"), (2, 2, "d")] == rows(sinks.range_replace(swapped, new, ["k"], "t"))


def test_archive_and_ids(spark, tmp_path):
    df = spark.range(1, 26).select(F.col("id").alias("ID"), F.lit("it''s").alias("v"))
    log = sinks.archive(df, str(tmp_path / "a"), "ID", 5, 10)
    assert rows(log) == [("0000000000000006", 6, 15, 10), ("0000000000000016", 16, 25, 10)]
    assert spark.read.option("header", "true").option("quote", "'").csv(str(tmp_path / "a")).count() == 20
    assert [r["n"] for r in sinks.assign_ids(spark.range(7).toDF("x"), "n", 100, ["x"]).orderBy("x").collect()] == list(range(101, 108))


def test_kml_and_gpx(spark, tmp_path):
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>7</ele><time>2020-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    p = tables.read_gpx(spark, str(tmp_path / "t.gpx"))
    assert tuple(p.select("t", "lat", "lon", "ele").first()) == (1577836800, 1.5, 2.5, 7.0)
    t = sinks.kml_track(p.withColumn("name", F.lit("a<b")), "name", "t", "lon", "lat").first()["kml"]
    assert "<name>a&lt;b</name>" in t and "<gx:coord>2.500000 1.500000 0</gx:coord>" in t
    sinks.kml_document(sinks.kml_points(p.withColumn("name", F.lit("n")), "name", "t", "lon", "lat"), "placemark", str(tmp_path / "k"), ["t"])
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "k")).count() == 3


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,x y\n2,\n")
    assert rows(tables.read_csv(spark, str(tmp_path / "c.csv"))) == [("1", "x y"), ("2", None)]
    (tmp_path / "t.dat").write_text("# note\n$volt,11.5:0,12.5:1,MAX:2\n")
    assert rows(tables.read_thresholds(spark, str(tmp_path / "t.dat"))) == [("volt", 11.5, 0), ("volt", 12.5, 1), ("volt", float("inf"), 2)]
    line = spark.createDataFrame([("*host ref 1 u 5 64 377 0.5 -1.25 0.1",), (" host ref 1 u 5 64 377 0.5 9 0.1",)], "l string")
    assert [r[0] for r in line.select(tables.clock_offset(F.col("l"))).collect()] == [-1.25, None]
    eav = spark.createDataFrame([(1, "band3", "5"), (1, "band10", ""), (1, "pulse_rate", "60.5")], "txID int, name string, value string")
    assert rows(tables.typed_parameters(eav)) == [(1, 5, None, 60.5, None)]
    with pytest.raises(KeyError, match="no table"):
        tables.by_name({"Site": eav}, "nothing")
    assert tables.by_name({"Site": eav}, "SITE") is eav


def test_schedule_wraps_midnight(spark):
    df = spark.createDataFrame([("17:59",), ("18:00",), ("03:00",), ("07:00",), ("07:01",)], "c string")
    assert [r[0] for r in df.select(filters.on_schedule(F.lit("18:00-7:00"), F.col("c"))).collect()] == [False, True, True, True, False]


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", v) for v in (0, 0, 20, 40, 60)], "k string, v int")
    assert rows(aggregates.equal_bins(df, ["k"], "v", 20).select("bin", "n")) == [(0, 2), (1, 1), (2, 1), (3, 1)]
    m = aggregates.mode_and_moment(aggregates.equal_bins(df, ["k"], "v", 20), ["k"]).first()
    assert m["mode"] == 7 and m["n"] == 5


def burst(n=4000, at=2500):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(n, 4)) + 1j * rng.normal(size=(n, 4))) * 0.1
    x[at : at + 160] += 0.5
    return x


def test_detector_gives_one_record_for_a_burst_and_rearms():
    x = burst()
    assert len(detector.detect(x)) == 1 and abs(detector.detect(x)[0][0] - 2659) < 40
    assert len(detector.detect(np.concatenate([x, x[1500:]]))) == 2


def test_stream_equals_batch(spark, tmp_path):
    power = (np.abs(burst()) ** 2).sum(axis=1)
    chunks = [("s", 1, k, power[a : a + 500].tolist()) for k, a in enumerate(range(0, len(power), 500))]
    schema = "site string, band int, seq long, power array<double>"
    for k in (1, 0, 2, 3):
        spark.createDataFrame(chunks[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detector.detect_stream(stream).writeStream.format("memory").queryName("pulses").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r)[2:4] for r in spark.table("pulses").collect())
    want = sorted(p[:2] for p in detector.State(Detector()).step(power))
    assert len(got) == len(want) == 1 and got[0][0] == want[0][0] and abs(got[0][1] - want[0][1]) < 1e-12


def test_micro_batches_upsert(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, v double").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema("id long, v double").parquet(str(tmp_path / "in"))
    q = batches.process(stream, lambda b: b.withColumn("v", F.col("v") * 2), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(f"{out}/0")) == [(1, 4.0), (2, 6.0)]
    cursors = spark.createDataFrame([("position", 9), ("score", 4)], "name string, value long")
    assert batches.cursor_of(cursors, "position", "score") == 4 and batches.cursor_of(cursors, "none") == 0


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows_ = [(f"2020-01-01 00:0{m}:{s:02d}", "a", 1.0) for m in range(5) for s in (1, 31)]
    df = spark.createDataFrame(rows_, "t string, k string, value double").withColumn("ts", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = batches.windowed_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [2] * 5


def test_configuration_is_frozen():
    with pytest.raises(Exception):  # noqa: B017
        Scoring().interval_ms = 1
    assert windows.resolved(start=1, width=2) == (1, 3) and windows.shifted(0, 5, -1) == (-5, 0)


def plain_detector(power, cfg):
    """The detector's table of states, one sample at a time, with sums taken anew each time."""
    clipped, out, state, floor, used = [], [], "below", 0.0, 0
    for at, x in enumerate(power.tolist()):
        if at < cfg.save_width:
            clipped.append(x)
            if at == cfg.save_width - 1:
                floor, used = sum(clipped[-cfg.pulse_width :]), cfg.pulse_width
            continue
        clipped.append(min(x, (2 * cfg.rise - 1) / cfg.pulse_width * floor))
        level, average = sum(clipped[-cfg.pulse_width :]), False
        if state == "below":
            if level > cfg.rise * floor:
                state, best, where = "peak", level, at
            else:
                average = True
        elif state in ("peak", "above"):
            count = 0 if state == "peak" else count
            state, count = "above", count + 1
            if level > best:
                state, best, where = "peak", level, at
            elif count >= cfg.confirmation:
                state = "trigger"
                out.append((where, best, floor))
        else:
            state = "below" if level < 0.9 * cfg.rise * floor else "post"
            average = True
        if average:
            if used < cfg.time_constant:
                floor = floor * used / (used + 1.0) + level / (used + 1.0)
                used += 1
            else:
                floor += (level - floor) / cfg.time_constant
    return out


def test_detector_equals_a_plain_state_table(spark):
    rng = np.random.default_rng(12)
    cfg = Detector(pulse_width=8, save_width=24, rise=1.3, time_constant=60, confirmation=4)
    power = rng.exponential(size=4000)
    for at in range(200, 3900, 370):
        power[at : at + 8] += 6
    power[1111] = 1e6  # one strong sample is clipped to a share of the floor
    got, want = detector.State(cfg).step(power), plain_detector(power, cfg)
    assert [g[0] for g in got] == [w[0] for w in want] and len(got) > 5
    np.testing.assert_allclose([g[1:3] for g in got], [w[1:] for w in want], rtol=1e-9)
    rows = spark.createDataFrame([(k, i, float(p)) for k in ("a", None) for i, p in enumerate(power)], "k string, i long, p double").repartition(3)
    found = detector.detect_ordered(rows, "k", "i", "p", cfg).collect()
    assert {k: sorted(r["peak"] for r in found if r["k"] == k) for k in ("a", None)} == dict.fromkeys(("a", None), [w[0] for w in want])


def test_model_fit_takes_off_phase_offsets(spark):
    rng = np.random.default_rng(5)
    angle = np.radians(np.arange(360))
    pattern = np.exp(1j * np.stack([1.3 * np.cos(angle), 2.1 * np.sin(angle), -0.7 * np.cos(angle + 0.4), 1.9 * np.sin(angle - 1)], axis=1)) / 2
    names = [f"{c}{p}" for c in range(1, 5) for p in "ri"]
    flat = lambda v: [float(x) for z in v for x in (z.real, z.imag)]
    model = spark.createDataFrame([(b, *flat(pattern[b])) for b in range(360)], "bearing int, " + ", ".join(f"m{x} double" for x in names))
    orders, offsets = [(1, 2, 3, 4), (1, 3, 4, 2), (1, 4, 3, 2)], np.array([0, 0.8, -1.1, 2.0])
    real = np.roll(pattern[:, [0, 2, 3, 1]], 77, axis=0) * np.exp(-1j * offsets) + 0.005 * (rng.normal(size=(360, 4)) + 1j * rng.normal(size=(360, 4)))
    measured = spark.createDataFrame([(9, b, *flat(real[b])) for b in range(0, 360, 2)], "site int, bearing int, " + ", ".join(f"sv{x} double" for x in names))
    got = direction.fit_model(model, measured, orders).collect()
    assert len(got) == 1 and (got[0]["order"], got[0]["turn"]) == (1, 77) and got[0]["score"] < 0.01
    np.testing.assert_allclose(np.exp(1j * np.array(got[0]["offsets"])), np.exp(1j * offsets[1:]), atol=0.02)
