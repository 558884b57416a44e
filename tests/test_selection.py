"""Order without whole groups: order statistics by selection, carried states, ranges; and likelihoods by factored matrices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixwave.operators import aggregates, direction, filters, pieces


def key(v):
    return (v != v, v if v == v else 0)


@pytest.mark.parametrize(("bins", "levels"), [(32, [0.6]), (1024, [0.0, 0.45, 1.0])])
def test_order_statistic_by_selection(spark, bins, levels):
    rng = random.Random(bins)
    inf, nan = math.inf, math.nan
    groups = {
        "plain": [rng.gauss(0, 1) for _ in range(400)],
        "ties": [float(rng.randrange(4)) for _ in range(300)],
        "one": [7.5],
        "same": [2.0] * 200,
        "far": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(200)],
        "odd": [nan, nan, inf, -inf, 1.0, 2.0, 1.7e308, -1.7e308, inf, -inf] * 3 + [5e-324, 0.0, -0.5],
        "ends": [-inf] * 40 + [inf] * 40,
        "last": [1.0] * 20 + [nan] * 80,
        None: [rng.random() for _ in range(100)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("plain", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for level in levels:
        got = dict(map(tuple, aggregates.order_statistic(df, ["k"], "v", level, "w", bins=bins, few=3).collect()))
        want = {k: sorted(vs, key=key)[min(len(vs) - 1, int(len(vs) * level))] for k, vs in groups.items()}
        assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))
    assert aggregates.order_statistic(df.limit(0), ["k"], "v", 0.5, "w").count() == 0


def test_order_statistic_of_long_integers_is_exact(spark):
    base = 2**60
    df = spark.createDataFrame([("a", base + 3 * k % 101) for k in range(101)], "k string, v long")  # alike as floating point
    assert aggregates.order_statistic(df, ["k"], "v", 0.5, "w", few=3).first()["w"] == base + 50


def test_order_statistic_orders_no_group(spark, capsys):
    df = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    out = aggregates.order_statistic(df, ["k"], "v", 0.9, "w", few=50)
    assert out.first()["w"] == sorted(k * 7919 % 100_003 for k in range(100_000))[90_000]


def test_flags_are_carried_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, 5.0, 30.0, 30.0, 30.0, 80.0])) for k in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        out = filters.hysteresis(spark.createDataFrame(rows, "g string, t long, v double"), ["g"], ["t"], "v", 10.0, 60.0)
        got = {r["t"]: r["powered"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    now = {}
    for g, t, v in rows:
        now[g] = now.get(g) if v is None or 10 <= v <= 60 else v > 60
        assert got[t] == now[g]


def test_a_thousand_ranges(spark):
    df = spark.range(50_000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 50_021).alias("t"))
    rows = pieces.split(df, ["t"], 1000)
    sizes = [r["count"] for r in rows.groupBy(pieces.PIECE).count().collect()]
    assert len(sizes) > 900 and max(sizes) < 400
    edges = rows.groupBy(pieces.PIECE).agg(F.min("t").alias("a"), F.max("t").alias("z")).orderBy(pieces.PIECE).collect()
    assert all(x["z"] < y["a"] for x, y in zip(edges, edges[1:]))


def test_factored_likelihood_equals_numpy(spark):
    rng = np.random.default_rng(6)
    n, names = 12, [f"{c}{p}" for c in range(1, 5) for p in "ri"]
    draw = lambda *s: rng.normal(size=s) + 1j * rng.normal(size=s)
    v, g, a = draw(n, 4), draw(5, 4), draw(n, 4, 6)
    noise, strength = a @ a.conj().transpose(0, 2, 1), rng.random(n) * 3
    flat = lambda z: [float(x) for c in z for x in (c.real, c.imag)]
    pulses = [(i, 0, float(strength[i]), *flat(v[i]), *flat(noise[i].ravel())) for i in range(n)] + [(99, 0, 0.0, *flat(v[0]), *[0.0] * 32)]
    cols = ", ".join([*[f"ed{x} double" for x in names], *[f"nc{i}{j}{p} double" for i in range(1, 5) for j in range(1, 5) for p in "ri"]])
    left = spark.createDataFrame(pulses, f"id int, site int, edsp double, {cols}")
    right = spark.createDataFrame([(0, b, *flat(g[b])) for b in range(5)], "site int, bearing int, " + ", ".join(f"sv{x} double" for x in names))
    got = {(r["id"], r["bearing"]): r["power"] for r in direction.mle(left, right, ["site"]).collect()}
    want = direction.spectrum_batch("mle", v, g, noise, strength)
    np.testing.assert_allclose([[got[i, b] for b in range(5)] for i in range(n)], want, rtol=1e-9)
    for i in range(3):
        for b in range(5):
            r = strength[i] * np.outer(g[b], g[b].conj()) + noise[i]
            assert want[i, b] == pytest.approx(-np.log(abs(np.linalg.det(r)) * np.pi**4) - abs(v[i].conj() @ np.linalg.inv(r) @ v[i]))
    assert got[99, 0] is None  # a matrix without an inverse


def test_sight_over_a_pyramid_equals_sampling_whole_rays(spark):
    from fixwave.operators import terrain

    rng = np.random.default_rng(8)
    where = terrain.Raster(0.0, 630.0, 10.0, 64, 48)
    z = np.cumsum(rng.normal(size=(64, 48)), axis=0) * 3
    z[20:24, 10:12] += 60
    raster = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(64) for j in range(48) if (i, j) != (5, 5)], "row int, col int, elevation double")
    site = (240.0, 300.0, 5.0)
    points = [(k, float(rng.uniform(-100, 600)), float(rng.uniform(-100, 800)), float(rng.uniform(-20, 60))) for k in range(150)] + [(900, 240.0, 300.0, 9.0), (901, 245.0, 300.0, 9.0), (902, 260.0, 300.0, -500.0)]
    df = spark.createDataFrame(points, "id int, easting double, northing double, elevation double")
    got = {r["id"]: (r["distance"], r["visible"]) for r in terrain.line_of_sight(df, "id", raster, where, site, 7.0).collect()}
    seen = 0
    for k, e, n, h in points:
        d = math.hypot(e - 240, n - 300)
        a = math.degrees(math.atan2(h - 5, d))
        clear, s = True, 7.0
        while s < d:
            x, y = 240 + (e - 240) * s / d, 300 + (n - 300) * s / d
            half_up = lambda v: math.floor(v + 0.5) if v >= 0 else math.ceil(v - 0.5)
            i, j = min(63, max(0, half_up((630 - y) / 10))), min(47, max(0, half_up(x / 10)))
            if (i, j) != (5, 5) and math.degrees(math.atan2(z[i, j] - 5, s)) > a:
                clear = False
            s += 7.0
        assert got[k][0] == pytest.approx(d) and got[k][1] == clear, k
        seen += clear
    assert 20 < seen < 130


def test_pyramid_has_the_greatest_of_each_tile(spark):
    from fixwave.operators import terrain

    raster = spark.createDataFrame([(i, j, float(i * 10 - j)) for i in range(5) for j in range(3)], "row int, col int, elevation double")
    got = {tuple(r)[:3]: r["top"] for r in terrain.pyramid(raster, terrain.Raster(0.0, 0.0, 1.0, 5, 3)).collect()}
    assert got[0, 4, 2] == 38.0 and got[1, 1, 0] == 30.0 and got[2, 1, 0] == 40.0 and got[3, 0, 0] == 40.0 and max(k[0] for k in got) == 3


def test_paths_of_windows_equal_paths_over_edges():
    from fixwave.operators import track

    rng = np.random.default_rng(11)
    for family in ("linear", "exp", "const"):
        for n in (0, 1, 2, 60):
            t = np.sort(rng.integers(0, 40, n) * 50.0)  # some at one time
            x, y, ll = rng.normal(size=n) * 30, rng.normal(size=n) * 30, np.round(rng.normal(size=n), 1)
            model = (family, 1.2, 0.5, 0.3)
            parents = {}
            for b in range(n):
                for a in range(n):
                    if t[a] < t[b] and math.hypot(x[a] - x[b], y[a] - y[b]) / (t[b] - t[a]) < track.speeds(*model, np.array([t[b] - t[a]]))[0]:
                        parents.setdefault(b, []).append(a)
            assert track.window_path(t, x, y, ll, model) == track.critical_path(np.arange(n), t, ll, parents)
    with pytest.raises(ValueError):
        track.speeds("warp", 1.0, 1.0, 1.0, np.array([1.0]))
