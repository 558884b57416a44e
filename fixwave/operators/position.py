"""Positions from bearing spectra: sums over sliding windows, periodic splines, and a two-pass grid search per window."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.config import Positioning
from fixwave.operators.aggregates import activity, argmax, vector_sum
from fixwave.operators.direction import spectra
from fixwave.operators.joins import interval_join
from fixwave.session import reach_workers

#: Grid points times sites whose geometry a worker keeps (about 50 bytes each, for two grids).
CELLS = 4_000_000


def second_derivatives(knots: np.ndarray) -> np.ndarray:
    """Of the periodic cubic spline through values at whole degrees (the circulant system 1, 4, 1, solved by FFT)."""
    n = len(knots)
    right = 6 * (np.roll(knots, 1) - 2 * knots + np.roll(knots, -1))
    return np.fft.irfft(np.fft.rfft(right) / (4 + 2 * np.cos(2 * np.pi * np.arange(n // 2 + 1) / n)), n)


def spline(knots: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    m = second_derivatives(knots)
    x = np.mod(degrees, len(knots))
    k = np.minimum(x.astype(np.int64), len(knots) - 1)
    t, j = x - k, (k + 1) % len(knots)
    s = 1 - t
    return s * knots[k] + t * knots[j] + ((s**3 - s) * m[k] + (t**3 - t) * m[j]) / 6


def surface(sites: np.ndarray, knots: list[np.ndarray], east: np.ndarray, north: np.ndarray) -> np.ndarray:
    """The summed spline of all sites (easting, northing) at each point."""
    out = np.zeros(np.broadcast(east, north).shape)
    for (e, n), k in zip(sites, knots):
        out += spline(k, np.degrees(np.arctan2(east - e, north - n)))
    return out


def _best(sites, knots, east, north) -> tuple[float, float, float]:
    """The first greatest point, easting outer, northing inner; rows are evaluated in blocks."""
    best = (-np.inf, 0.0, 0.0)
    for i in range(0, len(east), 64):
        z = surface(sites, knots, east[i : i + 64, None], north[None, :])
        k = int(z.argmax())
        if z.flat[k] > best[0]:
            best = (float(z.flat[k]), float(east[i + k // len(north)]), float(north[k % len(north)]))
    return best


@functools.lru_cache(maxsize=2)
def _weights(sites: bytes, box: tuple, step: float) -> tuple:
    """The axes of a grid, and for each site the knots around each point's bearing and their weights in the spline.

    They are the same for all windows of the same sites, which follow each other in a task.
    """
    e0, e1, n0, n1 = box
    east, north = np.arange(e0, e1 + step / 2, step), np.arange(n0, n1 + step / 2, step)
    out = []
    for e, n in np.frombuffer(sites).reshape(-1, 2):
        x = np.mod(np.degrees(np.arctan2(east[:, None] - e, north[None, :] - n)), 360)
        k = np.minimum(x.astype(np.intp), 359)
        t = x - k
        s = 1 - t
        out.append((k, (k + 1) % 360, s, t, s**3 - s, t**3 - t))
    return east, north, out


def search(sites: np.ndarray, knots: list[np.ndarray], box: tuple[float, float, float, float], cfg: Positioning = Positioning()) -> tuple[float, float, float]:
    """(likelihood, easting, northing) of the best point: a coarse grid over the box, then a fine one where it is near its best.

    The coarse grid is evaluated once. Up to ``CELLS`` points and sites its geometry is kept for the next window; beyond that the
    grid goes by blocks of rows, twice.
    """
    e0, e1, n0, n1 = box
    east, north = np.arange(e0, e1 + cfg.coarse_m / 2, cfg.coarse_m), np.arange(n0, n1 + cfg.coarse_m / 2, cfg.coarse_m)
    limit_of = lambda top: cfg.near_best * top if top > 0 else top - (1 - cfg.near_best) * abs(top)
    low, high = np.array([np.inf, np.inf]), np.array([-np.inf, -np.inf])
    if len(east) * len(north) * len(sites) <= CELLS and all(len(k) == 360 for k in knots):
        z = np.zeros((len(east), len(north)))
        for v, (k, j, s, t, a, b) in zip(knots, _weights(np.ascontiguousarray(sites, float).tobytes(), tuple(map(float, box)), cfg.coarse_m)[2]):
            m = second_derivatives(v)
            z += s * v[k] + t * v[j] + (a * m[k] + b * m[j]) / 6
        r, c = np.nonzero(z >= limit_of(z.max()))
        low, high = np.array([east[r.min()], north[c.min()]]), np.array([east[r.max()], north[c.max()]])
    else:
        limit = limit_of(_best(sites, knots, east, north)[0])
        for i in range(0, len(east), 64):
            r, c = np.nonzero(surface(sites, knots, east[i : i + 64, None], north[None, :]) >= limit)
            if len(r):
                low = np.minimum(low, [east[i + r.min()], north[c.min()]])
                high = np.maximum(high, [east[i + r.max()], north[c.max()]])
    fine = [np.arange(a, b + cfg.fine_m / 2, cfg.fine_m) for a, b in zip(low, high)]
    return _best(sites, knots, *fine)


def bearings(pulses: DataFrame, steering: DataFrame, cfg: Positioning = Positioning(), method: str = "bartlett") -> DataFrame:
    """(deployment, site, centre, bearing, likelihood, activity, n, knots) of each site and window, from pulses with ``t`` in seconds."""
    return summed(interval_join(spectra(pulses, steering, method), ["deployment"], "t", int(cfg.step_s), int(cfg.window_s)))


def single_bearings(pulses: DataFrame, steering: DataFrame, method: str = "bartlett") -> DataFrame:
    """The same of one window for each deployment, which holds all its pulses: for positions of things that don't move.

    Spectra are summed by bearing before anything is gathered, so a range of any length costs a site 360 sums.
    """
    return summed(spectra(pulses, steering, method).withColumn("centre", F.lit(0).cast("long")))


def summed(rows: DataFrame) -> DataFrame:
    """Bearings from pulses with their spectrum and window."""
    by = ["deployment", "site", "centre"]
    sums = vector_sum(rows, by, "spectrum", "knots").join(rows.groupBy(*by).agg(F.count("*").cast("int").alias("n")), by)
    spread = sums.select(*by, F.explode("knots").alias("p")).groupBy(*by).agg(activity(F.col("p")).alias("activity"))
    return sums.join(spread, by).select(*by, argmax(F.col("knots")).cast("double").alias("bearing"), (F.array_max("knots") / F.col("n")).alias("likelihood"), "activity", "n", "knots")


def positions(sums: DataFrame, sites: DataFrame, margin: float = 1500.0, cfg: Positioning = Positioning()) -> DataFrame:
    """(deployment, centre, easting, northing, likelihood, activity, n, n_sites) of windows with two sites or more.

    ``sites`` has site, easting and northing. The search covers the sites' box and ``margin`` metres around.
    """
    reach_workers(sums.sparkSession)
    rows = sums.join(sites.select("site", "easting", "northing"), "site")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site")
        if len(pdf) < 2:
            return pd.DataFrame([], columns=NAMES)
        xy = pdf[["easting", "northing"]].to_numpy(float)
        knots = [np.asarray(k) for k in pdf["knots"]]
        low, high = xy.min(axis=0) - margin, xy.max(axis=0) + margin
        top, e, n = search(xy, knots, (low[0], high[0], low[1], high[1]), cfg)
        count = int(pdf["n"].sum())
        return pd.DataFrame([[key[0], key[1], e, n, top / count, pdf["activity"].mean(), count, len(pdf)]], columns=NAMES)

    kind = rows.schema["deployment"].dataType.simpleString()
    return rows.groupBy("deployment", "centre").applyInPandas(run, f"deployment {kind}, centre long, easting double, northing double, likelihood double, activity double, n int, n_sites int")


NAMES = ["deployment", "centre", "easting", "northing", "likelihood", "activity", "n", "n_sites"]
