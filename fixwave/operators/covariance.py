"""Covariances of positions: asymptotic, and by bootstrap over sites, over pairs of sites, and over cases.

All start from the spectra of single pulses in a window and the window's position. Coordinate 1 is easting, 2 northing.

Asymptotic: the likelihood of a place is a sum of periodic splines of bearings, so its gradient and Hessian have closed forms.
Each pulse is a row of five numbers, worked out in Arrow batches; what remains are sums by Spark: H of all pulses of a window, B of
the gradients of its k-th pulses over all sites, and the sandwich H^-1 B H^-1 as a Column expression. No window is gathered.

Bootstrap: a group is one window, whose pulses are bounded by its length. A draw's place is found on a grid of ``coarse`` metres
around the position and one of ``fine`` metres around the best point. The coarse grid's bearings are worked out once a window and
serve all draws. The first half of the draws gives the Mahalanobis levels, the second half the covariance. Draws follow from the
seed, the deployment and the window, so that a task that runs again has the same.

Defined results: a window whose draws are none is ``undefined``, one whose matrix can't be inverted ``singular``, and one with a
negative eigenvalue ``nonposdef``; these have no levels. Pulses of sites without coordinates drop out.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement, product
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixwave.config import Positioning
from fixwave.functions import geo
from fixwave.operators.direction import spectra
from fixwave.operators.joins import interval_join, small
from fixwave.operators.position import second_derivatives
from fixwave.session import reach_workers

LEVELS = {"w68": 0.68, "w80": 0.80, "w90": 0.90, "w95": 0.95, "w99": 0.997}
RESAMPLES = 200
BY = ["deployment", "centre"]
SUMMARY = "method string, status string, n_draws int, m double, cov11 double, cov12 double, cov22 double, " + ", ".join(f"{w} double" for w in LEVELS)


def windowed(pulses: DataFrame, steering: DataFrame, positions: DataFrame, sites: DataFrame, cfg: Positioning = Positioning(), method: str = "bartlett") -> DataFrame:
    """Each pulse (deployment, site, t and channels) of each window that has a position, with its spectrum, where its site is
    (se, sn) and the position (pe, pn)."""
    rows = interval_join(spectra(pulses, steering, method), ["deployment"], "t", int(cfg.step_s), int(cfg.window_s))
    at = positions.select(*BY, F.col("easting").alias("pe"), F.col("northing").alias("pn"))
    where = sites.select("site", F.col("easting").alias("se"), F.col("northing").alias("sn"))
    return rows.join(small(where), "site").join(at, BY).select(*BY, "site", "t", "spectrum", "se", "sn", "pe", "pn")


# asymptotic


def derivatives(knots: np.ndarray, degrees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the periodic spline of each row of ``knots`` at one bearing."""
    m = np.stack([second_derivatives(k) for k in knots]) if len(knots) else np.empty((0, 1))
    n = knots.shape[1]
    x = np.mod(degrees, n)
    k = np.minimum(x.astype(np.int64), n - 1)
    t, j, row = x - k, (k + 1) % n, np.arange(len(knots))
    s = 1 - t
    first = knots[row, j] - knots[row, k] + ((3 * t**2 - 1) * m[row, j] - (3 * s**2 - 1) * m[row, k]) / 6
    return first, s * m[row, k] + t * m[row, j]


def _slopes(frames):
    for pdf in frames:
        if not len(pdf):
            continue
        de, dn = (pdf["pe"] - pdf["se"]).to_numpy(), (pdf["pn"] - pdf["sn"]).to_numpy()
        r2 = de**2 + dn**2
        with np.errstate(divide="ignore", invalid="ignore"):
            first, second = derivatives(np.stack(pdf["spectrum"].to_list()), np.degrees(np.arctan2(de, dn)))
            a, b = np.degrees(dn / r2), np.degrees(-de / r2)  # of the bearing by easting and northing
            h = {"h11": second * a * a + first * np.degrees(-2 * de * dn / r2**2), "h12": second * a * b + first * np.degrees((de**2 - dn**2) / r2**2), "h22": second * b * b + first * np.degrees(2 * de * dn / r2**2)}
        yield pd.DataFrame({**{c: pdf[c] for c in (*BY, "site", "t")}, "g1": first * a, "g2": first * b, **h})


def slopes(rows: DataFrame) -> DataFrame:
    """(deployment, centre, site, t, g1, g2, h11, h12, h22): what each pulse adds to gradient and Hessian at the position."""
    reach_workers(rows.sparkSession)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*BY, "site", "t"))
    return rows.mapInPandas(_slopes, f"{kinds}, g1 double, g2 double, h11 double, h12 double, h22 double")


def asymptotic(rows: DataFrame) -> DataFrame:
    """(deployment, centre, method, status, m, cov11, cov12, cov22, lambda1, lambda2, alpha) of windows, by the sandwich estimator.

    m is the number of pulses by site, and B the mean outer product of the gradients of the first m pulses of all sites, taken
    together by place in time; places that a site lacks don't count.
    """
    each = slopes(rows)
    counts = each.groupBy(*BY, "site").agg(F.count("*").alias("n"))
    size = counts.groupBy(*BY).agg(F.count("*").alias("n_sites"), F.least(F.floor(F.sum("n") / F.count("*")), F.min("n")).alias("m"))
    # a window of a site is a group of bounded size; pulses of one time are told apart by their gradients
    place = F.row_number().over(Window.partitionBy(*BY, "site").orderBy("t", "g1", "g2"))
    hessian = each.groupBy(*BY).agg(*[F.sum(h).alias(h) for h in ("h11", "h12", "h22")])
    sums = each.select(*BY, "g1", "g2", place.alias("k")).groupBy(*BY, "k").agg(F.sum("g1").alias("g1"), F.sum("g2").alias("g2"))
    outer = sums.join(size, BY).where("k <= m").groupBy(*BY).agg(F.max("m").alias("m"), *[F.avg(F.col(a) * F.col(b)).alias(f"b{n}") for n, a, b in ((11, "g1", "g1"), (12, "g1", "g2"), (22, "g2", "g2"))])
    x = hessian.join(outer, BY)
    det = F.col("h11") * F.col("h22") - F.col("h12") * F.col("h12")
    a11, a12, a22 = (F.try_divide(v, det) for v in (F.col("h22"), -F.col("h12"), F.col("h11")))
    x = x.withColumns({"a11": a11, "a12": a12, "a22": a22})
    # C = A B A, with symmetric A and B
    p = x.withColumns({"p11": F.expr("a11 * b11 + a12 * b12"), "p12": F.expr("a11 * b12 + a12 * b22"), "p21": F.expr("a12 * b11 + a22 * b12"), "p22": F.expr("a12 * b12 + a22 * b22")})
    c = p.select(*BY, F.lit("asym").alias("method"), F.col("m").cast("double").alias("m"), F.expr("p11 * a11 + p12 * a12").alias("cov11"), F.expr("p11 * a12 + p12 * a22").alias("cov12"), F.expr("p21 * a12 + p22 * a22").alias("cov22"))
    return with_axes(c.withColumn("status", F.when(F.col("cov11").isNull() | F.isnan("cov11"), "singular").otherwise("ok")))


def with_axes(rows: DataFrame) -> DataFrame:
    """Rows with lambda1, lambda2 and alpha (radians from east to the major axis), null unless the matrix is positive definite."""
    e = geo.ellipse(F.col("cov11"), F.col("cov12"), F.col("cov22"), F.lit(1.0))
    ok = (F.col("status") == "ok") & (e["lambda2"] > 0)
    out = rows.withColumn("__ok", ok).withColumns({k: F.when(F.col("__ok"), F.radians(e[k]) if k == "alpha" else e[k]) for k in ("lambda1", "lambda2", "alpha")})
    return out.withColumn("status", F.when((F.col("status") == "ok") & ~F.col("__ok"), "nonposdef").otherwise(F.col("status"))).drop("__ok")


# bootstrap


class Around:
    """Places of draws near a position: a coarse grid whose bearings serve all draws, then a fine one around each best point."""

    def __init__(self, sites: np.ndarray, centre: np.ndarray, half: float, coarse: float, fine: float):
        self.sites, self.coarse, self.fine = sites, coarse, fine
        steps = np.arange(-half, half + coarse / 2, coarse)
        self.east, self.north = (x.ravel() for x in np.meshgrid(centre[0] + steps, centre[1] + steps, indexing="ij"))
        self.at = self._weights(self.east[None], self.north[None])

    def _weights(self, east, north, n: int = 360):
        """For points (draws or 1, points): the knots on either side of each site's bearing, and their weights in the spline."""
        x = np.mod(np.degrees(np.arctan2(east[..., None] - self.sites[:, 0], north[..., None] - self.sites[:, 1])), n)
        k = np.minimum(x.astype(np.int64), n - 1)
        t = x - k
        return k, (k + 1) % n, 1 - t, t

    @staticmethod
    def _sum(at, knots, bent):
        """(draws, points): the summed splines of each draw's knots (draws, sites, 360) at its points."""
        out = 0.0
        draw = np.arange(len(knots))[:, None]
        for i in range(knots.shape[1]):
            k, j, s, t = (np.broadcast_to(v[..., i], (len(knots), v.shape[1])) for v in at)
            out = out + s * knots[draw, i, k] + t * knots[draw, i, j] + ((s**3 - s) * bent[draw, i, k] + (t**3 - t) * bent[draw, i, j]) / 6
        return out

    def best(self, knots: np.ndarray, block: int = 32) -> np.ndarray:
        """(draws, 2): the first greatest point of each draw."""
        out = np.empty((len(knots), 2))
        side = np.arange(-self.coarse, self.coarse + self.fine / 2, self.fine)
        de, dn = (x.ravel() for x in np.meshgrid(side, side, indexing="ij"))
        for b in range(0, len(knots), block):
            mine = knots[b : b + block]
            bent = np.stack([[second_derivatives(k) for k in draw] for draw in mine])
            top = np.argmax(self._sum(self.at, mine, bent), axis=1)
            east, north = self.east[top, None] + de, self.north[top, None] + dn
            fine = np.argmax(self._sum(self._weights(east, north), mine, bent), axis=1)
            row = np.arange(len(mine))
            out[b : b + block] = np.stack([east[row, fine], north[row, fine]], axis=1)
        return out


def summary(points: np.ndarray, m: float, method: str, apart: int = 0) -> list:
    """Covariance and Mahalanobis levels of draws, as in SUMMARY.

    The second half gives the covariance and the first half the levels; up to ``apart`` draws serve for both.
    """
    none = [None] * len(LEVELS)
    if len(points) < 2:
        return [method, "undefined", len(points), m, None, None, None, *none]
    half = len(points) // 2
    one, two = (points, points) if len(points) <= apart else (points[:half], points[half:])
    c = np.cov(two.T) if len(two) > 1 else np.full((2, 2), np.nan)
    det = c[0, 0] * c[1, 1] - c[0, 1] ** 2
    if not abs(det) > 1e-12 * max(1.0, abs(c[0, 0] * c[1, 1])):
        return [method, "singular", len(points), m, *(float(v) if np.isfinite(v) else None for v in (c[0, 0], c[0, 1], c[1, 1])), *none]
    scale, factor = {"boot": (m, 2.0)}.get(method, (1.0, 1.0))
    y = one - one.mean(axis=0)
    w = np.sort(np.einsum("ij,jk,ik->i", y, scale * np.linalg.inv(c), y))
    return [method, "ok", len(points), m, float(c[0, 0]), float(c[0, 1]), float(c[1, 1]), *[float(w[int(len(w) * q)]) * factor for q in LEVELS.values()]]


def _over_sites(rng, counts, sites, draws):
    """Which pulse of each site a draw takes: one of each."""
    return [(sites, np.array([rng.integers(0, counts[s], draws) for s in sites]).T)]


def _over_pairs(rng, counts, sites, draws):
    pairs = list(combinations(sites, 2))
    each = max(1, draws // max(1, len(pairs)))
    return [(list(p), np.array([rng.integers(0, counts[s], each) for s in p]).T) for p in pairs]


def _cases(rng, counts, draws):
    """How often each draw takes each pulse: resamples of each site to its own size, all of them if they are few, else unlike ones."""
    total = 1
    for n in counts:
        total *= comb(2 * n - 1, n)
    if total < draws:
        picks = product(*[combinations_with_replacement(range(n), n) for n in counts])
    else:
        picks = {}
        while len(picks) < draws:
            picks[tuple(tuple(sorted(rng.integers(0, n, n).tolist())) for n in counts)] = True
    return [np.concatenate([np.bincount(p, minlength=n) for p, n in zip(pick, counts)]) for pick in picks]


def bootstrap(rows: DataFrame, method: str = "boot3", draws: int = RESAMPLES, half: float = 75.0, coarse: float = 5.0, fine: float = 1.0, seed: int = 0) -> DataFrame:
    """(deployment, centre, SUMMARY, lambda1, lambda2, alpha) of windows of two sites or more, from ``windowed`` rows.

    ``method``: ``boot`` draws one pulse of each site; ``boot2`` one of each site of a pair, as often for each pair, in shuffled
    order; ``boot3`` resamples the cases of all sites. ``boot`` and ``boot2`` need two combinations of pulses.
    """
    if method not in ("boot", "boot2", "boot3"):
        raise ValueError(method)
    reach_workers(rows.sparkSession)
    names = [*BY, *[c.split()[0] for c in SUMMARY.split(", ")]]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__s=[tuple(x) for x in pdf["spectrum"]]).sort_values(["site", "t", "__s"])
        knots = np.stack(pdf["spectrum"].to_list())
        sites, first, counts = np.unique(pdf["site"].to_numpy(), return_index=True, return_counts=True)
        xy = pdf[["se", "sn"]].to_numpy()[first]
        m = len(pdf) / len(sites)
        rng = np.random.default_rng([seed, int(key[1]) % 2**32, sum(str(key[0]).encode())])
        points = np.empty((0, 2))
        if len(sites) > 1 and (method == "boot3" or np.prod(counts.astype(float)) >= 2):
            centre = pdf[["pe", "pn"]].to_numpy()[0]
            if method == "boot3":
                picks = np.array(_cases(rng, counts.tolist(), draws))
                edges = np.append(first, len(pdf))
                drawn = [(np.arange(len(sites)), np.stack([picks[:, a:b] @ knots[a:b] for a, b in zip(edges[:-1], edges[1:])], axis=1))]
            else:
                plan = (_over_sites if method == "boot" else _over_pairs)(rng, counts, list(range(len(sites))), draws)
                drawn = [(np.array(s), knots[first[np.array(s)] + p]) for s, p in plan]
            points = np.concatenate([Around(xy[s], centre, half, coarse, fine).best(k) for s, k in drawn])
            if method == "boot2":
                rng.shuffle(points)
        return pd.DataFrame([[*key, *summary(points, m, method, 100 if method == "boot3" else 0)]], columns=names)

    kind = rows.schema["deployment"].dataType.simpleString()
    return with_axes(rows.groupBy(*BY).applyInPandas(run, f"deployment {kind}, centre long, {SUMMARY}"))


def regions(covariances: DataFrame, positions: DataFrame, level: str = "w95") -> DataFrame:
    """Confidence ellipses of stored covariances at a stored level: centre, half axes and angle; null where the status isn't ok."""
    if level not in LEVELS:
        raise ValueError(level)
    ok = F.col("status") == "ok"
    axis = lambda k: F.when(ok, F.sqrt(F.col(level) * F.col(f"lambda{k}"))).alias(f"axis{k}")
    return covariances.join(positions.select(*BY, "easting", "northing"), BY).select(*BY, "status", "easting", "northing", axis(1), axis(2), F.when(ok, F.col("alpha")).alias("alpha"))
