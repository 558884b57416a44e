"""Receiver tuning: which band of a filter bank a frequency falls in, and few tunings that cover all frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_of(frequency: Column, center: Column, width: float, bands: int) -> Column:
    """The band's number: whole widths from the centre, negative ones counted from the end; null outside the bank."""
    k = F.round((frequency - center) / width).cast("int")
    return F.when(F.abs(frequency - center) <= width * bands / 2.0, F.pmod(k, F.lit(bands)))


def merged_bands(tx: DataFrame, by: list[str]) -> DataFrame:
    """What a detector needs for all transmitters of a band: the longest pulse and save width, the least rise."""
    return tx.groupBy(*by).agg(F.max("pulse_width").alias("pulse_width"), F.max("save_width").alias("save_width"), F.min("rise").alias("rise"), F.sort_array(F.collect_set("name")).alias("names"))


def cover(frequencies: list[float], step: float, reach: float) -> list[float]:
    """Tunings, multiples of ``step``, so that each frequency is within ``reach`` of one: those that alone reach a frequency
    first, then always the one that reaches most of the rest, the least of equals."""
    feasible = {f: {k for k in range(int(-(-(f - reach) // step)), int((f + reach) // step) + 1)} for f in frequencies}
    if any(not t for t in feasible.values()):
        raise ValueError("a frequency is out of reach of every tuning")
    chosen = {next(iter(t)) for t in feasible.values() if len(t) == 1}
    left = {f for f, t in feasible.items() if not t & chosen}
    while left:
        best = max(sorted({k for f in left for k in feasible[f]}), key=lambda k: sum(k in feasible[f] for f in left))
        chosen.add(best)
        left = {f for f in left if best not in feasible[f]}
    return sorted(k * step for k in chosen)
