"""Direction finding: bearing spectra of pulses against steering vectors, and calibration of those vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.functions.scalar import conj, inner, power, times
from fixwave.operators.aggregates import argmax, gram_matrix
from fixwave.session import reach_workers

CHANNELS = range(1, 5)


def signal_columns(prefix: str, side: str = "") -> list[tuple]:
    return [(F.col(f"{side}{prefix}{c}r"), F.col(f"{side}{prefix}{c}i")) for c in CHANNELS]


def bartlett(pulses: DataFrame, steering: DataFrame, on: list[str], signal: str = "ed", vector: str = "sv") -> DataFrame:
    """Each pulse with each bearing of its site and the power |v g*|^2; plain arithmetic, in generated code."""
    both = pulses.join(steering, on)
    return both.withColumn("power", power(inner(signal_columns(signal), signal_columns(vector))))


def mle(pulses: DataFrame, steering: DataFrame, on: list[str], signal: str = "ed", vector: str = "sv", noise: str = "nc", strength: str = "edsp") -> DataFrame:
    """Each pulse with each bearing of its site and the log likelihood ``power`` of its covariance strength g g* + noise.

    The 4 x 4 complex matrix is factored column by column (L U, no pivots: a covariance has none that is zero) as plain
    arithmetic in generated code: the product of pivots is the determinant, and substitution gives the quadratic form. A matrix
    that is singular gives null.
    """
    both = pulses.join(steering, on)
    made: list[str] = []

    def put(values: dict) -> None:
        nonlocal both
        both = both.withColumns({f"__{k}{p}": x for k, pair in values.items() for p, x in zip("ri", pair)})
        made.extend(f"__{k}{p}" for k in values for p in "ri" if f"__{k}{p}" not in made)

    at = lambda k: (F.col(f"__{k}r"), F.col(f"__{k}i"))
    minus = lambda a, b: (a[0] - b[0], a[1] - b[1])
    g, v = signal_columns(vector), signal_columns(signal)
    s = F.col(strength)
    matrix = {}
    for a in CHANNELS:
        for b in CHANNELS:
            re, im = times(g[a - 1], conj(g[b - 1]))
            matrix[f"m{a}{b}"] = (s * re + F.col(f"{noise}{a}{b}r"), s * im + F.col(f"{noise}{a}{b}i"))
    put(matrix | {f"y{a}": v[a - 1] for a in CHANNELS})
    for k in (1, 2, 3):
        put({f"l{i}": quotient(at(f"m{i}{k}"), at(f"m{k}{k}")) for i in range(k + 1, 5)})
        put({f"m{i}{j}": minus(at(f"m{i}{j}"), times(at(f"l{i}"), at(f"m{k}{j}"))) for i in range(k + 1, 5) for j in range(k + 1, 5)} | {f"y{i}": minus(at(f"y{i}"), times(at(f"l{i}"), at(f"y{k}"))) for i in range(k + 1, 5)})
    for i in (4, 3, 2, 1):
        rest = at(f"y{i}")
        for j in range(i + 1, 5):
            rest = minus(rest, times(at(f"m{i}{j}"), at(f"x{j}")))
        put({f"x{i}": quotient(rest, at(f"m{i}{i}"))})
    quad = inner([at(f"x{a}") for a in CHANNELS], v)
    pivots = [F.col(f"__m{a}{a}r") ** 2 + F.col(f"__m{a}{a}i") ** 2 for a in CHANNELS]
    logdet = sum((F.log(p) for p in pivots), F.lit(0.0)) / 2
    return both.withColumn("power", -(logdet + 4 * float(np.log(np.pi))) - F.sqrt(power(quad))).drop(*made)


def quotient(a: tuple, b: tuple) -> tuple:
    re, im = times(a, conj(b))
    size = b[0] * b[0] + b[1] * b[1]
    return F.try_divide(re, size), F.try_divide(im, size)


def spectrum_batch(method: str, v: np.ndarray, g: np.ndarray, noise: np.ndarray | None = None, strength: np.ndarray | None = None) -> np.ndarray:
    """(pulses, bearings) likelihoods of signal vectors v (n x 4) over steering vectors g (360 x 4)."""
    return METHODS[method](v, g, noise, strength)


def _bartlett(v, g, noise, strength):
    return np.abs(v @ g.conj().T) ** 2


def _mle(v, g, noise, strength, block: int = 16):
    out = np.empty((len(v), len(g)))
    outer = g[:, :, None] * g[:, None, :].conj()
    for i in range(0, len(v), block):
        mine = v[i : i + block]
        r = strength[i : i + block, None, None, None] * outer + noise[i : i + block, None]
        x = np.linalg.solve(r, np.broadcast_to(mine[:, None, :, None], (*r.shape[:3], 1)))[..., 0]
        quad = np.abs(np.einsum("pa,pba->pb", mine.conj(), x))
        out[i : i + block] = -(np.linalg.slogdet(r)[1] + 4 * np.log(np.pi)) - quad
    return out


#: Spectrum estimators by name; others can be registered.
METHODS: dict[str, Callable] = {"bartlett": _bartlett, "mle": _mle}


def spectra(pulses: DataFrame, steering: DataFrame, method: str = "bartlett") -> DataFrame:
    """The pulses with ``spectrum``, an array over the bearings 0..359 of their site (sites without vectors drop out).

    ``steering`` has site and the arrays sv_re and sv_im of 360 x 4 numbers, one row a site: 23 kB each, so a thousand sites
    are joined as a small table. Pulses have ed1r..ed4i, and for mle nc11r..nc44i and edsp.
    """
    reach_workers(pulses.sparkSession)
    signal = [f"ed{c}{p}" for c in CHANNELS for p in "ri"]
    extra = [f"nc{a}{b}{p}" for a in CHANNELS for b in CHANNELS for p in "ri"] + ["edsp"] if method == "mle" else []

    @F.pandas_udf("array<double>")
    def run(cols: pd.DataFrame, re: pd.Series, im: pd.Series) -> pd.Series:
        out = np.empty(len(cols), object)
        v = np.stack([cols[f"ed{c}r"] + 1j * cols[f"ed{c}i"] for c in CHANNELS], axis=1)
        keys = re.map(lambda a: hash(np.asarray(a).tobytes()))
        for _, rows in keys.groupby(keys).groups.items():
            i = np.asarray(rows)
            g = (np.asarray(re[i[0]]) + 1j * np.asarray(im[i[0]])).reshape(-1, 4)
            noise = strength = None
            if method == "mle":
                noise = np.stack([np.stack([cols[f"nc{a}{b}r"][i] + 1j * cols[f"nc{a}{b}i"][i] for b in CHANNELS], axis=1) for a in CHANNELS], axis=1)
                strength = cols["edsp"][i].to_numpy()
            for k, row in zip(i, spectrum_batch(method, v[i], g, noise, strength)):
                out[k] = row
        return pd.Series(out)

    both = pulses.join(steering.select("site", "sv_re", "sv_im"), "site")
    return both.withColumn("spectrum", run(F.struct(*signal, *extra), "sv_re", "sv_im")).drop("sv_re", "sv_im")


def packed_steering(steering: DataFrame) -> DataFrame:
    """One row a site from rows of (site, bearing, sv1r..sv4i): 360 bearings in order."""
    parts = F.sort_array(F.collect_list(F.struct("bearing", F.array(*[f"sv{c}r" for c in CHANNELS]).alias("re"), F.array(*[f"sv{c}i" for c in CHANNELS]).alias("im"))))
    packed = steering.groupBy("site").agg(parts.alias("p"))
    return packed.select("site", F.flatten(F.transform("p", lambda x: x["re"])).alias("sv_re"), F.flatten(F.transform("p", lambda x: x["im"])).alias("sv_im"))


def steering_of(vectors: DataFrame, calibration: int, include: list[int] = ()) -> DataFrame:
    """One row a site of the stored vectors (siteID, cal_infoID, bearing, sv1r..sv4i) of a calibration, of some sites if any are
    named. A site that lacks one of the bearings 0..359 is an error when its row is read."""
    rows = vectors.where(F.col("cal_infoID") == calibration)
    if include:
        rows = rows.where(F.col("siteID").isin(list(include)))
    packed = packed_steering(rows.withColumn("site", F.col("siteID")).withColumn("bearing", F.col("bearing").cast("int")))
    whole = F.when(F.size("sv_re") == 4 * 360, F.col("sv_re")).otherwise(F.raise_error(F.concat(F.lit("bearings are missing for site "), F.col("site").cast("string"))).cast("array<double>"))
    return packed.withColumn("sv_re", whole)


def in_phase(re: list, im: list) -> tuple[list, list]:
    """Channels turned so that the first is real and positive."""
    size = F.hypot(re[0], im[0])
    c, s = F.coalesce(F.try_divide(re[0], size), F.lit(1.0)), F.coalesce(F.try_divide(-im[0], size), F.lit(0.0))
    return [r * c - i * s for r, i in zip(re, im)], [r * s + i * c for r, i in zip(re, im)]


def top_vectors(grams: DataFrame, by: list[str]) -> DataFrame:
    """The top eigenvector, first channel real, of each Gram matrix g11r..g44i; ``share`` is its part of the trace."""
    reach_workers(grams.sparkSession)
    names = [f"g{a}{b}{p}" for a in CHANNELS for b in CHANNELS for p in "ri"]
    fields = ", ".join(f"sv{c}{p} double" for c in CHANNELS for p in "ri")

    @F.pandas_udf(f"struct<{fields.replace(' double', ':double')}, share:double>")
    def run(cols: pd.DataFrame) -> pd.DataFrame:
        m = (cols[names[0::2]].to_numpy() + 1j * cols[names[1::2]].to_numpy()).reshape(-1, 4, 4)
        value, vector = np.linalg.eigh(m)
        top = vector[:, :, -1]
        first = top[:, :1]
        size = np.abs(first)
        top = top * np.where(size > 0, first.conj() / np.where(size > 0, size, 1), 1)
        out = {f"sv{c}{p}": x for c in CHANNELS for p, x in (("r", top[:, c - 1].real), ("i", top[:, c - 1].imag))}
        total = value.sum(axis=1)
        return pd.DataFrame(out | {"share": np.where(total > 0, value[:, -1] / np.where(total > 0, total, 1), 0.0)})

    return grams.withColumn("__v", run(F.struct(*names))).select(*by, "__v.*")


def calibrate(samples: DataFrame, span: int = 5, least: int = 1) -> DataFrame:
    """Steering vectors of (site, bearing): each sample counts for the whole degrees within half a span of its bearing,
    around the circle; of each degree, the top eigenvector of the samples' Gram matrix, if it has ``least`` of them."""
    low = F.floor(F.col("bearing") - span / 2.0).cast("int") + 1
    degrees = F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.pmod(low + k, F.lit(360)))
    re, im = in_phase([F.col(f"ed{c}r") for c in CHANNELS], [F.col(f"ed{c}i") for c in CHANNELS])
    rows = samples.select("site", F.explode(degrees).alias("degree"), *[x.alias(f"x{c}r") for c, x in zip(CHANNELS, re)], *[x.alias(f"x{c}i") for c, x in zip(CHANNELS, im)])
    grams = rows.groupBy("site", "degree").agg(F.count("*").alias("n"), *gram_matrix([F.col(f"x{c}r") for c in CHANNELS], [F.col(f"x{c}i") for c in CHANNELS]))
    return top_vectors(grams.where(F.col("n") >= least), ["site", "degree", "n"]).withColumnRenamed("degree", "bearing")


def wedge_calibration(samples: DataFrame, wedge: float, least: int = 11) -> DataFrame:
    """As ``calibrate``, of samples strictly within half a wedge of each whole degree, around the circle, from ``least`` up.

    The vector that fits all samples of a wedge best is the top eigenvector of their Gram matrix.
    """
    half = F.lit(wedge / 2.0)
    low, high = F.floor(F.col("bearing") - half).cast("int") + 1, F.ceil(F.col("bearing") + half).cast("int") - 1
    degrees = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    re, im = in_phase([F.col(f"ed{c}r") for c in CHANNELS], [F.col(f"ed{c}i") for c in CHANNELS])
    rows = samples.select("site", F.explode(degrees).alias("d"), *[x.alias(f"x{c}r") for c, x in zip(CHANNELS, re)], *[x.alias(f"x{c}i") for c, x in zip(CHANNELS, im)])
    rows = rows.withColumn("bearing", F.pmod("d", F.lit(360)))
    grams = rows.groupBy("site", "bearing").agg(F.count("*").alias("n"), *gram_matrix([F.col(f"x{c}r") for c in CHANNELS], [F.col(f"x{c}i") for c in CHANNELS]))
    return top_vectors(grams.where(F.col("n") >= least), ["site", "bearing", "n"])


def verified(samples: DataFrame, steering: DataFrame) -> DataFrame:
    """Each sample's bearing by the vectors against its own, and the error around the circle."""
    found = spectra(samples, packed_steering(steering)).withColumn("found", argmax(F.col("spectrum")))
    error = F.abs(F.pmod(F.col("found") - F.col("bearing") + 180.0, F.lit(360.0)) - 180.0)
    return found.withColumn("error", error).drop("spectrum")


def fit_model(model: DataFrame, measured: DataFrame, orders: list[tuple[int, ...]]) -> DataFrame:
    """For each site: the channel order and rotation of a model's vectors (bearing, m1r..m4i) nearest to the measured ones, the
    phase offset of each channel but the first, and the score, the mean of 1 - |m c*|^2 over measured bearings.

    Each of the candidates (orders x 360 rotations) is turned, channel by channel, by its mean unwrapped phase against the
    measured vectors before it is scored; the first of equals stands. The model is a table of 360 rows; a site has as many.
    """
    reach_workers(measured.sparkSession)
    names = [f"{c}{p}" for c in CHANNELS for p in "ri"]
    rows = sorted(model.select("bearing", *[f"m{x}" for x in names]).limit(360).collect())
    pattern = np.array([[complex(r[1 + 2 * k], r[2 + 2 * k]) for k in range(4)] for r in rows])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("bearing")
        real = np.stack([pdf[f"sv{c}r"].to_numpy() + 1j * pdf[f"sv{c}i"].to_numpy() for c in CHANNELS], axis=1)
        at = (pdf["bearing"].to_numpy(int)[None, :] - np.arange(len(pattern))[:, None]) % len(pattern)
        best = None
        for n, order in enumerate(orders):
            turned = pattern[:, [c - 1 for c in order]][at]  # rotation, bearing, channel
            offset = np.unwrap(np.angle(turned / real), axis=1).mean(axis=1) if len(real) else np.zeros((len(pattern), 4))
            offset[:, 0] = 0.0
            turned = turned * np.exp(-1j * offset)[:, None, :]
            score = 1 - (np.abs((np.conj(real)[None] * turned).sum(axis=2)) ** 2).mean(axis=1) if len(real) else np.full(len(pattern), np.inf)
            turn = int(score.argmin())
            if np.isfinite(score[turn]) and (best is None or score[turn] < best[3]):
                best = (key[0], n, turn, float(score[turn]), [float(x) for x in offset[turn, 1:]])
        return pd.DataFrame([best] if best else [], columns=["site", "order", "turn", "score", "offsets"])

    kind = measured.schema["site"].dataType.simpleString()
    return measured.select("site", "bearing", *[f"sv{x}" for x in names]).groupBy("site").applyInPandas(run, f"site {kind}, order int, turn int, score double, offsets array<double>")
