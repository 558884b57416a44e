"""Queries of pulse files: read as a source, landed with quarantine and replay, and detected from streams; covariances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixwave.config import Detector, Positioning
from fixwave.functions import scalar
from fixwave.operators import covariance, direction, position
from fixwave.plans.domain import simulated
from fixwave.plans.registry import query, table
from fixwave.session import reach_workers, shared
from fixwave.sources import det, det_source
from fixwave.streaming import quarantine, records

SIZE = 200  # events of a type to a record


def _records(spark: SparkSession, sf_dir: str, sample: str = "value") -> DataFrame:
    """All events as records of one channel: ``SIZE`` ids of a type to a file, at the time of the first, tagged by their number."""
    reach_workers(spark)
    packed = F.pandas_udf(lambda v: v.map(lambda x: np.asarray(x, np.complex64).tobytes()), "binary")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), F.floor(F.col("event_id") / SIZE).alias("chunk"), "event_id", F.floor(scalar.micros(F.col("ts")) / 1_000_000).alias("s"), F.expr(sample).alias("value"))
    g = e.groupBy("site", "chunk").agg(F.min("s").cast("double").alias("timestamp"), F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    g = g.select("site", "chunk", F.concat(F.lit("c"), F.col("chunk").cast("string")).alias("tag"), "timestamp", packed(F.col("v.value")).alias("samples"))
    return g.withColumns({"channels": F.lit(1), "pulse_at": F.lit(0), "pulse_n": F.lit(1), "rate": F.lit(8000.0), "center": F.lit(0.0)})


_CHUNKS = f"""SELECT site, chunk, n, strftime(began, '%Y-%m-%d %H:%M') AS minute, 'c' || chunk || '_' || strftime(began, '%S') || '000000.det' AS name
FROM (SELECT event_type AS site, event_id // {SIZE} AS chunk, count(*) AS n, make_timestamp(min(epoch_us(ts)) // 1000000 * 1000000) AS began FROM events GROUP BY ALL)"""


@query(f"""WITH c AS ({_CHUNKS}) SELECT site, minute, 'c' || chunk AS tag, n FROM c WHERE site IN ('click', 'view') AND minute >= '2024-01-02 00:00'""")
def s_det_source(spark, sf):
    """All events written as record files; those of two sites from a day on, read back by the source, which enters no other folder."""
    folder = shared(spark, "det")
    det.write(_records(spark, sf), folder)
    found = det_source.scan(spark, folder, sites="click,view", low="2024-01-02 00:00").where(F.col("site").isin("click", "view") & (F.col("minute") >= "2024-01-02 00:00"))
    return found.select("site", "minute", "tag", (F.length("samples") / 8).cast("long").alias("n"))


def _content():
    def run(frames):
        for pdf in frames:
            whole = [det.pack(np.frombuffer(r.samples, np.complex64).reshape(-1, 1), 0, 1, r.rate, r.center, r.timestamp) for r in pdf.itertuples()]
            yield pd.DataFrame({"site": pdf["site"], "chunk": pdf["chunk"], "path": [det.path_of(r.site, r.tag, r.timestamp) for r in pdf.itertuples()], "content": whole})

    return run


@query(f"""WITH c AS ({_CHUNKS}) SELECT site, minute, name, n, CASE WHEN chunk % 3 = 0 THEN 'replay' ELSE 'landing' END AS run, 'landed' AS state FROM c WHERE chunk % 3 <> 0 OR chunk % 6 = 0
UNION ALL SELECT site, minute, name, NULL, NULL, 'truncated header' FROM c WHERE chunk % 3 = 0 AND chunk % 6 <> 0""")
def r_quarantine(spark, sf):
    """All events as record files, every third of them cut short. The cut ones go to quarantine; half of these are repaired and
    replayed, twice, and land once; the rest stay open."""
    folder = shared(spark, "landing")
    files = _records(spark, sf).mapInPandas(_content(), "site string, chunk long, path string, content binary")
    files.write.parquet(f"{folder}/whole")
    whole = spark.read.parquet(f"{folder}/whole")
    whole.withColumn("content", F.when(F.col("chunk") % 3 == 0, F.substring("content", 1, 20)).otherwise(F.col("content"))).write.parquet(f"{folder}/in")
    sites = whole.select(F.col("site").alias("name")).distinct()
    read = lambda name: spark.readStream.schema(whole.schema).parquet(f"{folder}/{name}")
    quarantine.land(spark, read("in"), f"{folder}/store", sites, f"{folder}/log1")
    held = quarantine.still_open(spark, f"{folder}/store").select(*quarantine.KEY)
    mended = quarantine.keyed(whole.where("chunk % 6 = 0")).join(held, quarantine.KEY, "left_semi").select("path", "content", F.lit(0).cast("long").alias("chunk"), "site")
    mended.select(*whole.columns).write.parquet(f"{folder}/ready")
    for _ in range(2):
        spark.read.parquet(f"{folder}/ready").write.mode("append").parquet(f"{folder}/mended")
        quarantine.replay(spark, read("mended"), f"{folder}/store", sites, f"{folder}/log2")
    done = quarantine.landed(spark, f"{folder}/store", "records")
    n = (F.length("samples") / 8).cast("long")
    left = quarantine.still_open(spark, f"{folder}/store").select(*quarantine.KEY, F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("run"), F.col("error").alias("state"))
    return done.select(*quarantine.KEY, n.alias("n"), "run", F.lit("landed").alias("state")).unionByName(left)


DETECTOR = Detector(pulse_width=8, save_width=24, rise=1.4, time_constant=500, confirmation=4)


@query()
def r_records(spark, sf):
    """Pulses in the event values of each type, as a stream of chunks, with their samples; the same pulses as ``r_detector``."""
    folder = shared(spark, "records")
    e = _records(spark, sf, "sqrt(value)").select("site", F.lit(0).alias("band"), F.col("chunk").alias("seq"), F.timestamp_seconds("timestamp").alias("at"), "channels", "samples")
    e.write.parquet(f"{folder}/in")
    session = spark.newSession()  # typed state needs another state store than the default; the caller's session isn't changed
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = session.readStream.schema(e.schema).parquet(f"{folder}/in")
    found = records.pulse_records(stream, DETECTOR, most=1 << 20)
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(records.RECORDS).parquet(f"{folder}/out")


def _rows(spark, sf):
    """Pulses of all ``embeddings`` as in ``d_position``, by window, with positions on coarse grids."""
    sites, vectors, _ = simulated(spark, seconds=2)
    e = table(spark, sf, "embeddings")
    pulses = e.select(F.lit(0).alias("deployment"), (F.col("vec_id") % 3).cast("int").alias("site"), F.col("vec_id").alias("t"), *[F.col("embedding")[i].cast("double").alias(f"ed{i // 2 + 1}{'ri'[i % 2]}") for i in range(8)])
    cfg, steering = Positioning(coarse_m=25.0, fine_m=5.0), direction.packed_steering(vectors)
    at = position.positions(position.bearings(pulses, steering, cfg), sites, 200.0, cfg)
    at.write.parquet(folder := shared(spark, "positions"))
    at = spark.read.parquet(folder)
    return covariance.windowed(pulses, steering, at, sites, cfg), at


@query()
def d_covariance_asymptotic(spark, sf):
    return covariance.asymptotic(_rows(spark, sf)[0])


@query()
def d_covariance_sites(spark, sf):
    return covariance.bootstrap(_rows(spark, sf)[0], "boot")


@query()
def d_covariance_pairs(spark, sf):
    return covariance.bootstrap(_rows(spark, sf)[0], "boot2")


@query()
def d_confidence_regions(spark, sf):
    """Ellipses at 95 % of the case bootstrap."""
    rows, at = _rows(spark, sf)
    return covariance.regions(covariance.bootstrap(rows, "boot3"), at, "w95")


_G = ", ".join(f"avg(CAST(embedding[{k + 1}] AS DOUBLE)) AS g{k}" for k in range(8))
_V = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS v{k}" for k in range(8))
_RE = " + ".join(f"v{k} * g{k}" for k in range(8))
_IM = " + ".join(f"v{k + 1} * g{k} - v{k} * g{k + 1}" for k in range(0, 8, 2))


@query(f"""WITH v AS (SELECT vec_id, 0.5 + vec_id % 7 / 10.0 AS c, 2.0 + vec_id % 3 AS s, {_V} FROM embeddings), g AS (SELECT label AS bearing, {_G} FROM embeddings GROUP BY label),
p AS (SELECT vec_id, bearing, c, s, {" + ".join(f"g{k} * g{k}" for k in range(8))} AS gg, {" + ".join(f"v{k} * v{k}" for k in range(8))} AS vv, ({_RE}) ** 2 + ({_IM}) ** 2 AS gv FROM v CROSS JOIN g)
SELECT vec_id, bearing, round(-ln(c ** 3 * (c + s * gg)) - 4 * ln(pi()) - (vv / c - s * gv / (c * (c + s * gg))), 6) AS power FROM p""")
def d_mle(spark, sf):
    """Log likelihoods of all ``embeddings`` as pulses at all bearings, in white noise; SQL has the inverse in closed form for it."""
    names = [f"{c}{p}" for c in range(1, 5) for p in "ri"]
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0).alias("site"), *[F.col("embedding")[i].cast("double").alias(f"ed{n}") for i, n in enumerate(names)])
    g = e.groupBy(F.col("label").alias("bearing"), "site").agg(*[F.avg(f"ed{n}").alias(f"sv{n}") for n in names])
    white = {f"nc{a}{b}{p}": 0.5 + F.col("vec_id") % 7 / 10.0 if a == b and p == "r" else F.lit(0.0) for a in range(1, 5) for b in range(1, 5) for p in "ri"}
    pulses = e.drop("label").withColumns(white | {"edsp": 2.0 + F.col("vec_id") % 3})
    return direction.mle(pulses, g, ["site"]).select("vec_id", "bearing", F.round("power", 6).alias("power"))
