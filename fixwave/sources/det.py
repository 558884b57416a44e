"""Pulse record files: a header of 32 bytes and complex samples, read with Spark's binary source, written by tasks.

Header, little-endian: four 32-bit integers (channels, samples, pulse samples, pulse index), two 32-bit floats (sample rate,
centre frequency), two 32-bit integers (seconds, microseconds); then samples x channels complex64, channel by channel.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.session import reach_workers

HEADER = "<4i2f2i"
SCHEMA = "path string, site string, tag string, timestamp double, channels int, pulse_at int, pulse_n int, rate double, center double, samples binary, error string"


def parse(content: bytes) -> dict:
    """The fields of a record; raises ValueError for a bad one."""
    size = struct.calcsize(HEADER)
    if len(content) < size:
        raise ValueError("truncated header")
    channels, n, pulse_n, pulse_at, rate, center, sec, usec = struct.unpack_from(HEADER, content)
    if channels <= 0:
        raise ValueError("no channels")
    body = content[size : size + 8 * channels * n]
    if n < 0 or len(body) < 8 * channels * n:
        raise ValueError("truncated samples")
    if np.isnan(np.frombuffer(body, np.float32)).any():
        raise ValueError("a sample is not a number")
    return {"timestamp": sec + usec * 1e-6, "channels": channels, "pulse_at": pulse_at, "pulse_n": pulse_n, "rate": float(rate), "center": float(center), "samples": body}


def pack(samples: np.ndarray, pulse_at: int, pulse_n: int, rate: float, center: float, timestamp: float) -> bytes:
    usec = round(timestamp * 1e6)
    return struct.pack(HEADER, samples.shape[1], samples.shape[0], pulse_n, pulse_at, rate, center, *divmod(usec, 1_000_000)) + samples.astype("<c8").tobytes()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records below a folder; bad files have an error and null fields. Site is the folder's first level."""
    reach_workers(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.det").option("recursiveFileLookup", "true").load(folder)

    def run(frames):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in frames:
            rows = []
            for path, site, tag, content in zip(pdf["path"], pdf["site"], pdf["tag"], pdf["content"]):
                try:
                    rows.append({"path": path, "site": site, "tag": tag, "error": None} | parse(content))
                except ValueError as e:
                    rows.append({"path": path, "site": site, "tag": tag, "error": str(e)})
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("channels", "pulse_at", "pulse_n")})

    tag = F.regexp_extract("path", r"([^/]*)_[0-9]*\.det$", 1)
    site = F.regexp_extract("path", r"([^/]+)/[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}/[0-9]{2}/[^/]*$", 1)
    return files.select("path", F.nullif(site, F.lit("")).alias("site"), F.nullif(tag, F.lit("")).alias("tag"), "content").mapInPandas(run, SCHEMA)


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and (path, error) of bad ones for quarantine."""
    return records.where("error is null"), records.where("error is not null").select("path", "error")


def census(spark: SparkSession, folder: str, pattern: str = "*.det") -> DataFrame:
    """Files per site, from file metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)/[0-9]{4}/", 1).alias("site")).groupBy("site").agg(F.count("*").alias("n"))


def path_of(site: str, tag: str, timestamp: float) -> str:
    """site/YYYY/MM/DD/HH/MM/tag_SSuuuuuu.det in UTC."""
    from datetime import UTC, datetime

    usec = round(timestamp * 1e6)
    t = datetime.fromtimestamp(usec // 1_000_000, UTC)
    return f"{site}/{t:%Y/%m/%d/%H/%M}/{tag}_{t:%S}{usec % 1_000_000:06d}.det"


def write(records: DataFrame, folder: str) -> int:
    """Write records (site, tag, timestamp, channels, pulse_at, pulse_n, rate, center, samples) as files; returns how many.

    A file's name follows from its record and it appears by a rename, so that a repeated task writes the same files again.
    """
    reach_workers(records.sparkSession)

    def run(frames):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for pdf in frames:
            for r in pdf.itertuples():
                name = f"{root}/{path_of(r.site, r.tag, r.timestamp)}"
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                body = np.frombuffer(r.samples, np.complex64).reshape(-1, r.channels)
                with store.open_output_stream(f"{name}.part") as f:
                    f.write(pack(body, r.pulse_at, r.pulse_n, r.rate, r.center, r.timestamp))
                store.move(f"{name}.part", name)
            yield pd.DataFrame({"n": [len(pdf)]})

    return records.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
