"""Pulse detection on sample streams: a matched filter and a peak state machine for each site and band.

The filter is a rolling sum of ``pulse_width`` sample powers, each clipped to (2 rise - 1) / width times the noise floor; the
floor is of rolling sums. It is seeded with the sum when ``save_width`` samples have been seen, and is averaged on while the sum
is below the threshold, and after a pulse. State is a few numbers and the last ``pulse_width`` powers, so it is bounded whatever
the stream's length. The same function works on a whole recording at once.
"""

from __future__ import annotations

import itertools
import pickle
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixwave.config import Detector
from fixwave.session import reach_workers

BELOW, PEAK, AFTER = range(3)
PULSES = "peak long, level double, floor double, rate double"


FALL = 0.9


@dataclass
class State:
    cfg: Detector
    state: int = BELOW
    seen: int = 0  # samples so far
    used: int = 0  # sums in the floor
    floor: float = 0.0
    window: deque = field(default_factory=deque)  # clipped powers of the last pulse width
    total: float = 0.0
    best: float = 0.0
    best_at: int = 0
    waited: int = 0

    def _average(self, level: float) -> None:
        weight = 1.0 / (self.used + 1) if self.used < self.cfg.time_constant else 1.0 / self.cfg.time_constant
        self.used += self.used < self.cfg.time_constant
        self.floor += weight * (level - self.floor)

    def step(self, power: np.ndarray) -> list[tuple[int, float, float, float]]:
        """Feed the powers of consecutive samples; returns (peak, level, floor, rate) of pulses confirmed by them."""
        cfg, out = self.cfg, []
        clip = (2 * cfg.rise - 1) / cfg.pulse_width
        for x in power.tolist():
            at = self.seen
            self.seen += 1
            filling = at < cfg.save_width
            self.window.append(x if filling else min(x, clip * self.floor))
            self.total += self.window[-1]
            if len(self.window) > cfg.pulse_width:
                self.total -= self.window.popleft()
            level = self.total
            if filling:
                if self.seen == cfg.save_width:
                    self.floor, self.used = level, cfg.pulse_width
                continue
            if self.state == BELOW:
                if level > cfg.rise * self.floor:
                    self.state, self.best, self.best_at, self.waited = PEAK, level, at, 0
                else:
                    self._average(level)
            elif self.state == PEAK:
                self.waited += 1
                if level > self.best:
                    self.best, self.best_at, self.waited = level, at, 0
                elif self.waited >= cfg.confirmation:
                    out.append((self.best_at, self.best, self.floor, self.best / self.floor if self.floor else float("inf")))
                    self.state = AFTER
            else:
                if level < FALL * cfg.rise * self.floor:
                    self.state = BELOW
                self._average(level)
        return out


def detect(samples: np.ndarray, cfg: Detector = Detector()) -> list[tuple[int, float, float, float]]:
    """Pulses of one recording, samples x channels complex."""
    return State(cfg).step((np.abs(samples) ** 2).sum(axis=1))


def detect_ordered(rows: DataFrame, key: str, order: str, power: str, cfg: Detector = Detector()) -> DataFrame:
    """(key, peak, level, floor, rate): pulses of each key's samples taken in order, a batch of rows at a time.

    A null key is a key like others. Batches may end anywhere, and may be of nulls only: results go out with declared types.
    """
    reach_workers(rows.sparkSession)
    sorted_ = rows.select(key, order, F.col(power).cast("double").alias(power)).where(F.col(power).isNotNull()).repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        machine, now = None, None
        for batch in batches:
            keys = batch.column(0)
            names, values = keys.to_pylist(), batch.column(2).to_numpy()
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)] if names else []
            at, found = [], []
            for a, b in itertools.pairwise(edges):
                if machine is None or names[a] != now:
                    machine, now = State(cfg), names[a]
                pulses = machine.step(values[a:b])
                at += [a] * len(pulses)
                found += pulses
            columns = list(zip(*found)) or [()] * 4
            kinds = [pa.int64()] + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[key, "peak", "level", "floor", "rate"])

    return sorted_.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {PULSES}")


def detect_stream(chunks: DataFrame, cfg: Detector = Detector(), patience: int = 64) -> DataFrame:
    """Pulses of streams keyed by (site, band) from rows (site, band, seq, power: array of summed channel powers).

    Chunks that come before their predecessors wait in the state until these are there; if more than ``patience`` wait, the
    missing ones are taken for lost, and detection starts anew behind the gap. Samples are counted on from there, so that no two
    pulses of a stream have one number.
    """
    reach_workers(chunks.sparkSession)

    def run(key, frames, state):
        machine, due, waiting, base = pickle.loads(state.get[0]) if state.exists else (State(cfg), 0, {}, 0)
        found = []

        def feed():
            nonlocal due
            while due in waiting:
                found.extend((base + p, *rest) for p, *rest in machine.step(waiting.pop(due)))
                due += 1

        for pdf in frames:
            for s, p in zip(pdf["seq"], pdf["power"]):
                if int(s) >= due:
                    waiting[int(s)] = np.asarray(p, float)
                feed()
                if len(waiting) > patience:
                    due, base, machine = min(waiting), base + machine.seen, State(cfg)
                    feed()
        state.update((pickle.dumps((machine, due, waiting, base)),))
        yield pd.DataFrame([(*key, *p) for p in found], columns=["site", "band", "peak", "level", "floor", "rate"])

    return chunks.groupBy("site", "band").applyInPandasWithState(run, f"site string, band int, {PULSES}", "state binary", "append", "NoTimeout")
