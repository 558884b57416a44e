"""Corroboration scores of pulses: parameter and burst flags, the expected interval, and how many of a train's pulses are there.

A pulse scores -1 if its bandwidth exceeds its transmitter's limits, -2 in a burst, else the number of time bins, at whole
multiples of the expected interval from it, that hold a pulse; 0 if its own bin holds several. Rows need deployment, site,
``t`` (integer milliseconds), band3 and band10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixwave.config import Scoring
from fixwave.operators.aggregates import equal_bins, mode_and_moment
from fixwave.operators.joins import range_pairs
from fixwave.operators.windows import augmented

GROUP = ["deployment", "site", "interval"]
POOL = ["deployment", "interval"]


def parameter_flag(band3: Column, band10: Column, limit3: Column, limit10: Column) -> Column:
    """True if a bandwidth exceeds its limit; a missing limit is none."""
    return F.coalesce(band3 > limit3, F.lit(False)) | F.coalesce(band10 > limit10, F.lit(False))


def burst_bins(df: DataFrame, cfg: Scoring) -> DataFrame:
    """Bins of the widened interval that hold too many pulses; only of intervals with enough of them."""
    width = (cfg.interval_ms + 2 * cfg.context_ms) / cfg.burst_bins
    rows = df.where("not flagged").withColumn("__bin", F.least(F.floor((F.col("t") - F.col("interval") + cfg.context_ms) / width), F.lit(cfg.burst_bins - 1)))
    bins = rows.groupBy(*GROUP, "__bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("__all", F.sum("n").over(Window.partitionBy(*GROUP)))
    bad = bins.where((F.col("__all") >= cfg.burst_least) & (F.col("n") / cfg.burst_seconds > cfg.burst_rate))
    low = F.col("interval") - cfg.context_ms + F.col("__bin") * width
    return bad.groupBy(*GROUP).agg(F.collect_list(F.struct(low.alias("low"), (low + width).alias("high"))).alias("bursts"))  # burst_bins at most


def expected_interval(df: DataFrame, rate: float, cfg: Scoring) -> DataFrame:
    """(mode, moment) in milliseconds of a deployment's gaps in an interval; zero for two gaps or fewer.

    Gaps are between pulses of one site and near the nominal interval; those of all sites make one histogram. ``rate`` is the
    nominal number of pulses a minute.
    """
    least, most = 60_000 * cfg.interval_low / rate, 60_000 * cfg.interval_high / rate
    gaps = range_pairs(df.select(*GROUP, "t"), GROUP, "t", least, most, []).select(*POOL, (F.col("t_2") - F.col("t_1")).alias("gap"))
    found = mode_and_moment(equal_bins(gaps, POOL, "gap", cfg.mode_bin_ms), POOL)
    return found.select(*POOL, F.when(F.col("n") > 2, F.col("mode")).otherwise(0).cast("long").alias("pulse_interval"), F.when(F.col("n") > 2, F.col("moment")).otherwise(0.0).alias("pulse_variation"))


def corroborate(df: DataFrame, cfg: Scoring) -> DataFrame:
    """Pulses (unflagged) with their score by the ``pulse_interval`` (0: none) of their deployment and interval."""
    rows = df.withColumn("__own", (F.floor(F.col("t") / cfg.bin_ms) * cfg.bin_ms).cast("long"))
    bins = rows.groupBy(*GROUP, "__own").agg(F.count("*").alias("__n"))
    reach = F.floor(F.lit(cfg.reach_ms) / F.col("pulse_interval")).cast("int")
    steps = F.when((F.col("pulse_interval") > 0) & (F.col("pulse_interval") <= cfg.reach_ms), F.sequence(1 - reach, reach - 1)).otherwise(F.array().cast("array<int>"))
    probes = F.array_distinct(F.transform(steps, lambda k: (F.floor((F.col("t") + k * F.col("pulse_interval")) / cfg.bin_ms) * cfg.bin_ms).cast("long")))
    asked = rows.select(*GROUP, "id", "__own", F.explode(probes).alias("__bin"))
    there = asked.join(bins.select(*GROUP, F.col("__own").alias("__bin")), [*GROUP, "__bin"], "left_semi").groupBy(*GROUP, "id").agg(F.count("*").alias("__hits"))
    rows = rows.join(bins, [*GROUP, "__own"]).join(there, [*GROUP, "id"], "left")
    score = (
        F.when(F.col("pulse_interval") == 0, 0)
        .when(F.col("__n") > 1, 0)
        .when(F.col("pulse_interval") > cfg.reach_ms, -1)
        .otherwise(F.coalesce("__hits", F.lit(0)) - 1)
    )
    return rows.withColumn("score", score.cast("long")).drop("__own", "__n", "__hits")


def score(pulses: DataFrame, rate: float, limits: DataFrame | None = None, cfg: Scoring = Scoring()) -> tuple[DataFrame, DataFrame]:
    """Scores (id, deployment, site, interval, t, score, max_score, theoretical_score) and intervals of all pulses.

    ``limits`` has deployment, limit3 and limit10. Each pulse is scored in its own interval, with those near it as context.
    """
    rows = pulses
    if limits is not None:
        rows = rows.join(limits, "deployment", "left").withColumn("flagged", parameter_flag(F.col("band3"), F.col("band10"), F.col("limit3"), F.col("limit10"))).drop("limit3", "limit10")
    else:
        rows = rows.withColumn("flagged", F.lit(False))
    rows = augmented(rows, "t", cfg.interval_ms, cfg.context_ms)
    rows = rows.join(burst_bins(rows, cfg), GROUP, "left")
    burst = F.coalesce(F.exists("bursts", lambda b: (F.col("t") >= b["low"]) & (F.col("t") <= b["high"])), F.lit(False)) & ~F.col("flagged")
    rows = rows.withColumn("burst", burst).drop("bursts")
    found = expected_interval(rows.where("not flagged and not burst"), rate, cfg)
    # a site's chunk, context and flagged pulses included, is scored if it has more than two pulses and an interval was found
    chunks = rows.groupBy(*GROUP).agg(F.count("*").alias("__chunk")).join(found, POOL, "left")
    use = (F.col("__chunk") > 2) & (F.coalesce("pulse_interval", F.lit(0)) > 0)
    chunks = chunks.select(*GROUP, F.when(use, F.col("pulse_interval")).otherwise(0).cast("long").alias("pulse_interval"), "pulse_variation")
    rows = rows.join(chunks.select(*GROUP, "pulse_interval"), GROUP)
    scored = corroborate(rows.where("not flagged and not burst").select(*GROUP, "id", "t", "core", "pulse_interval"), cfg)
    other = rows.where("flagged or burst").select(*GROUP, "id", "t", "core", "pulse_interval", F.when(F.col("flagged"), -1).otherwise(-2).cast("long").alias("score"))
    theory = F.when(F.col("pulse_interval") > 0, F.floor(F.lit(2 * cfg.reach_ms) / F.nullif(F.col("pulse_interval"), F.lit(0).cast("long")))).otherwise(0)
    out = scored.select(*other.columns).unionByName(other).withColumn("theoretical_score", theory.cast("long"))
    # the greatest score of the whole chunk, whose context is cut off after that
    most = F.when(F.col("pulse_interval") > 0, F.max("score").over(Window.partitionBy(*GROUP))).otherwise(0).cast("long")
    out = out.withColumn("max_score", most).where("core").select(*GROUP, "id", "t", "score", "theoretical_score", "max_score")
    return out, chunks.where("pulse_interval > 0")
