"""Features of pulse records: Fourier and eigen decompositions, noise covariance and levels, for Arrow batches of records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fixwave.session import reach_workers

COLUMNS = (
    ["tag", "timestamp", "deployment", "frequency", "center", "fdsp", "band3", "band10", "edsp", "ec", "tnp", "fdsnr", "edsnr"]
    + [f"fd{c}{p}" for c in range(1, 5) for p in "ri"]
    + [f"ed{c}{p}" for c in range(1, 5) for p in "ri"]
    + [f"nc{a}{b}{p}" for a in range(1, 5) for b in range(1, 5) for p in "ri"]
)
_KIND = {"tag": "string", "timestamp": "double", "deployment": "long", "frequency": "int", "center": "int", "band3": "int", "band10": "int"}
SCHEMA = ", ".join(f"{c} {_KIND.get(c, 'double')}" for c in COLUMNS)


def fourier(pulse: np.ndarray, rate: float, center: float) -> dict:
    """Peak bin over all channels: its unit signal vector, power, frequency, and bandwidths 3 and 10 dB down."""
    f = np.fft.fft(pulse, axis=0)
    power = (np.abs(f) ** 2).sum(axis=1)
    k, n = int(power.argmax()), len(pulse)
    width = rate / n
    vector = f[k] / np.linalg.norm(f[k]) if power[k] > 0 else f[k]
    return {"vector": vector, "power": float(power[k]) / n**2 * width, "frequency": int(center + np.fft.fftfreq(n, 1 / rate)[k]), "band3": int((power > power[k] / 2).sum() * width), "band10": int((power > power[k] / 10).sum() * width)}


def eigen(pulse: np.ndarray, rate: float) -> dict:
    """The top eigenvector of the pulse's Gram matrix, its power, and its share of all power."""
    value, vector = np.linalg.eigh(pulse.conj().T @ pulse)
    total = value.sum()
    return {"vector": vector[:, -1], "power": float(value[-1]) / len(pulse) * rate, "confidence": float(value[-1] / total) if total > 0 else 0.0}


def noise(samples: np.ndarray, start: int, width: int, rate: float) -> np.ndarray | None:
    """Covariance of a pulse-long slice half way between the pulse and the record's end; none if it doesn't fit."""
    at = (len(samples) - start - width) // 2
    part = samples[at : at + width] if at >= 0 else samples[:0]
    return part.conj().T @ part / width * rate if len(part) == width else None


def features_of(samples: np.ndarray, pulse_at: int, pulse_n: int, rate: float, center: float) -> dict:
    pulse = samples[pulse_at : pulse_at + pulse_n]
    f, e, c = fourier(pulse, rate, center), eigen(pulse, rate), noise(samples, pulse_at, pulse_n, rate)
    tnp = float(np.trace(c).real) if c is not None else None
    level = lambda p: 10 * float(np.log10(p / tnp)) if tnp and p > 0 else None
    out = {"frequency": f["frequency"], "center": int(center), "fdsp": f["power"], "band3": f["band3"], "band10": f["band10"], "edsp": e["power"], "ec": e["confidence"], "tnp": tnp, "fdsnr": level(f["power"]), "edsnr": level(e["power"])}
    for name, v in (("fd", f["vector"]), ("ed", e["vector"])):
        out |= {f"{name}{k + 1}{p}": float(x) for k in range(min(4, len(v))) for p, x in (("r", v[k].real), ("i", v[k].imag))}
    if c is not None:
        out |= {f"nc{a + 1}{b + 1}{p}": float(x) for a in range(min(4, len(c))) for b in range(min(4, len(c))) for p, x in (("r", c[a, b].real), ("i", c[a, b].imag))}
    return out


def features(records: DataFrame) -> DataFrame:
    """One row of features for each good record of ``sources.det.read``; the deployment is the number in tags like ID12."""
    reach_workers(records.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                samples = np.frombuffer(r.samples, np.complex64).reshape(-1, r.channels).astype(np.complex128)
                digits = r.tag[2:] if r.tag and r.tag.startswith("ID") and r.tag[2:].isdigit() else None
                rows.append({"tag": r.tag, "timestamp": r.timestamp, "deployment": int(digits) if digits else None} | features_of(samples, r.pulse_at, r.pulse_n, r.rate, r.center))
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"deployment": "Int64"})

    good = records.where("error is null").select("tag", "timestamp", "channels", "pulse_at", "pulse_n", "rate", "center", "samples")
    return good.mapInPandas(run, SCHEMA)
