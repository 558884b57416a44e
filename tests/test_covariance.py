"""Covariances of positions against numerical derivatives and plain resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixwave.config import Positioning
from fixwave.operators import covariance, direction, position
from fixwave.plans.domain import simulated

CFG = Positioning(coarse_m=25.0, fine_m=5.0)


@pytest.fixture(scope="module")
def rows(spark):
    sites, vectors, pulses = simulated(spark, seconds=90, noise=0.05)
    steering = direction.packed_steering(vectors)
    at = position.positions(position.bearings(pulses, steering, CFG), sites, 200.0, CFG)
    at = spark.createDataFrame(at.collect(), at.schema)
    out = covariance.windowed(pulses, steering, at, sites, CFG)
    return spark.createDataFrame(out.collect(), out.schema), at


def likelihood(pulses, e, n):
    return sum(float(position.spline(np.asarray(r["spectrum"]), np.array([np.degrees(np.arctan2(e - r["se"], n - r["sn"]))]))[0]) for r in pulses)


def numeric(f, e, n, h=0.05):
    g = np.array([(f(e + h, n) - f(e - h, n)) / (2 * h), (f(e, n + h) - f(e, n - h)) / (2 * h)])
    cross = (f(e + h, n + h) - f(e + h, n - h) - f(e - h, n + h) + f(e - h, n - h)) / (4 * h * h)
    return g, np.array([[(f(e + h, n) - 2 * f(e, n) + f(e - h, n)) / h**2, cross], [cross, (f(e, n + h) - 2 * f(e, n) + f(e, n - h)) / h**2]])


def test_asymptotic_equals_numerical_derivatives(rows):
    got = {r["centre"]: r for r in covariance.asymptotic(rows[0]).collect()}
    assert got and all(r["status"] == "ok" and r["method"] == "asym" for r in got.values())
    every = rows[0].collect()
    for centre, r in got.items():
        mine = sorted((p for p in every if p["centre"] == centre), key=lambda p: (p["site"], p["t"]))
        e, n = mine[0]["pe"], mine[0]["pn"]
        by_site = {s: [p for p in mine if p["site"] == s] for s in {p["site"] for p in mine}}
        m = min(len(mine) // len(by_site), *[len(v) for v in by_site.values()])
        a = np.linalg.inv(numeric(lambda x, y: likelihood(mine, x, y), e, n)[1])
        b = np.zeros((2, 2))
        for i in range(m):
            g = numeric(lambda x, y, i=i: likelihood([v[i] for v in by_site.values()], x, y), e, n)[0]
            b += np.outer(g, g) / m
        c = a @ b @ a
        np.testing.assert_allclose([r["cov11"], r["cov12"], r["cov22"]], [c[0, 0], c[0, 1], c[1, 1]], rtol=2e-3)
        w, v = np.linalg.eigh(c)
        np.testing.assert_allclose([r["lambda1"], r["lambda2"]], w[::-1], rtol=2e-3)
        assert abs(np.sin(r["alpha"] - np.arctan2(v[1, 1], v[0, 1]))) < 2e-3 and r["m"] == m


def test_a_pulse_at_its_site_gives_no_number(rows):
    assert covariance.asymptotic(rows[0].withColumns({"pe": F.col("se"), "pn": F.col("sn")})).where("status = 'ok'").count() == 0


def test_draws_find_the_best_point_of_the_grid():
    rng = np.random.default_rng(4)
    sites, knots = rng.normal(size=(3, 2)) * 500, rng.random((5, 3, 360))
    knots = np.stack([[np.convolve(np.tile(k, 3), np.ones(40) / 40, "same")[360:720] for k in d] for d in knots])
    around = covariance.Around(sites, np.array([20.0, 30.0]), 60.0, 5.0, 1.0)
    got = around.best(knots, block=2)
    side, near = np.arange(-60.0, 60.1, 5.0), np.arange(-5.0, 5.1, 1.0)
    for d, k in enumerate(knots):
        z = position.surface(sites, list(k), 20 + side[:, None], 30 + side[None, :])
        i, j = np.unravel_index(np.argmax(z), z.shape)
        fine = position.surface(sites, list(k), 20 + side[i] + near[:, None], 30 + side[j] + near[None, :])
        a, b = np.unravel_index(np.argmax(fine), fine.shape)
        np.testing.assert_allclose(got[d], [20 + side[i] + near[a], 30 + side[j] + near[b]])


@pytest.mark.parametrize(("method", "factor"), [("boot", 2.0), ("boot2", 1.0), ("boot3", 1.0)])
def test_halves_give_covariance_and_levels(method, factor):
    points = np.random.default_rng(5).normal(size=(120, 2)) @ np.array([[3.0, 1.0], [0.0, 2.0]])
    got = covariance.summary(points, 4.0, method, 100 if method == "boot3" else 0)
    c = np.cov(points[60:, 0], points[60:, 1])
    y = points[:60] - points[:60].mean(axis=0)
    w = sorted(float(v @ ((4.0 if method == "boot" else 1.0) * np.linalg.inv(c)) @ v) * factor for v in y)
    assert got[:4] == [method, "ok", 120, 4.0]
    np.testing.assert_allclose(got[4:], [c[0, 0], c[0, 1], c[1, 1], *[w[int(60 * q)] for q in (0.68, 0.8, 0.9, 0.95, 0.997)]])


def test_awkward_draws():
    assert covariance.summary(np.empty((0, 2)), 1.0, "boot")[1] == "undefined"
    assert covariance.summary(np.ones((50, 2)), 1.0, "boot2")[1] == "singular"
    small = np.random.default_rng(1).normal(size=(40, 2))
    assert covariance.summary(small, 1.0, "boot3", 100)[4] == pytest.approx(np.cov(small.T)[0, 0])


def test_pairs_are_drawn_alike_and_cases_are_unlike():
    rng = np.random.default_rng(6)
    pairs = covariance._over_pairs(rng, [3, 4, 5], [0, 1, 2], 200)
    assert [p for p, _ in pairs] == [[0, 1], [0, 2], [1, 2]] and all(d.shape == (66, 2) for _, d in pairs)
    assert all(d[:, k].max() < [3, 4, 5][s] for p, d in pairs for k, s in enumerate(p))
    few = covariance._cases(rng, [2, 2], 200)
    assert len(few) == 9 and all(c[:2].sum() == 2 and c[2:].sum() == 2 for c in few)
    many = covariance._cases(rng, [6, 6], 50)
    assert len({tuple(c) for c in many}) == 50


@pytest.mark.parametrize("method", ["boot", "boot2", "boot3"])
def test_bootstrap_is_near_and_repeatable(rows, method):
    pulses, at = rows
    got = covariance.bootstrap(pulses, method, draws=60).orderBy("centre").collect()
    assert got and got == covariance.bootstrap(pulses.repartition(5), method, draws=60).orderBy("centre").collect()
    for r in got:
        assert r["status"] == "ok" and r["n_draws"] in (60, 3 * 20) and 0 < r["lambda2"] <= r["lambda1"] < 75**2
        assert r["w68"] <= r["w80"] <= r["w90"] <= r["w95"] <= r["w99"]
        assert r["lambda1"] * r["lambda2"] == pytest.approx(r["cov11"] * r["cov22"] - r["cov12"] ** 2)
    regions = covariance.regions(covariance.bootstrap(pulses, method, draws=60), at, "w90").collect()
    by = {r["centre"]: r for r in got}
    assert all(r["axis1"] == pytest.approx((by[r["centre"]]["w90"] * by[r["centre"]]["lambda1"]) ** 0.5) for r in regions)


def test_one_site_is_undefined(rows):
    got = covariance.bootstrap(rows[0].where("site = 1"), "boot").collect()
    assert got and all(r["status"] == "undefined" and r["cov11"] is None and r["lambda1"] is None for r in got)
    with pytest.raises(ValueError):
        covariance.bootstrap(rows[0], "boot9")


def test_kept_geometry_gives_the_same_position(monkeypatch):
    rng = np.random.default_rng(9)
    sites = rng.normal(size=(3, 2)) * 400
    for _ in range(4):
        knots = [np.convolve(np.tile(k, 3), np.ones(30) / 30, "same")[360:720] for k in rng.random((3, 360))]
        kept = position.search(sites, knots, (-300.0, 300.0, -200.0, 250.0), CFG)
        with monkeypatch.context() as m:
            m.setattr(position, "CELLS", 0)
            assert position.search(sites, knots, (-300.0, 300.0, -200.0, 250.0), CFG) == kept


def test_single_position_is_that_of_all_pulses(spark):
    sites, vectors, pulses = simulated(spark, seconds=60)
    steering = direction.packed_steering(vectors)
    sums = position.single_bearings(pulses, steering).collect()
    assert len(sums) == 3 and all(r["n"] == 30 for r in sums)
    p = position.positions(position.single_bearings(pulses, steering), sites, 200.0, CFG).collect()
    assert len(p) == 1 and abs(p[0]["easting"] - 200) <= 15 and abs(p[0]["northing"] - 300) <= 15 and p[0]["n"] == 90
