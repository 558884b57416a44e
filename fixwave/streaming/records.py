"""Pulse records from sample streams: a confirmed pulse comes out with its samples, as a field node would file it.

State is typed and bounded for each (site, band): numbers of the detector and the last powers of its filter; a ring of the last
chunks, which holds at least the ``save_width`` samples that a record has; and chunks that wait for one before them. A chunk that
doesn't come is given up by a timer, when the watermark is ``patience`` milliseconds past the time of the first chunk that waits
for it, or at once when ``most`` wait; detection then starts anew behind the gap, with an empty ring, and samples are counted on.
Time is that of the chunks, not of the clock, so a stream that is run again gives up the same chunks.

A record has the ``save_width`` samples that end where the pulse was confirmed, so the pulse's place in it is the same for all.
The result is rows of ``sources.det``: what they lack in a header is ``rate`` and ``center`` of the stream, which the caller adds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fixwave.config import Detector
from fixwave.session import reach_workers
from fixwave.streaming.detector import State

CHUNKS = "site string, band int, seq long, at timestamp, channels int, samples binary"
RECORDS = "site string, band int, peak long, seq long, level double, floor double, channels int, pulse_at int, pulse_n int, samples binary"
_MACHINE = "state int, seen long, used long, floor double, total double, best double, best_at long, waited int, base long, due long, since long"


class PulseRecords(StatefulProcessor):
    def __init__(self, cfg: Detector, patience: int, most: int):
        self.cfg, self.patience, self.most = cfg, patience, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", _MACHINE)
        self.powers = handle.getValueState("powers", "window array<double>")
        self.ring = handle.getListState("ring", "seq long, first long, channels int, samples binary")
        self.waiting = handle.getMapState("waiting", "seq long", "channels int, samples binary")

    def _load(self) -> None:
        cfg = self.cfg
        if self.machine.exists():
            v = self.machine.get()
            window = deque(self.powers.get()[0])
            self.now = State(cfg, v[0], v[1], v[2], v[3], window, v[4], v[5], v[6], v[7])
            self.base, self.due, self.since = v[8], v[9], v[10]
            self.kept = [tuple(r) for r in self.ring.get()]
        else:
            self.now, self.base, self.due, self.since, self.kept = State(cfg), 0, 0, -1, []
        self.seqs = {k[0] for k in list(self.waiting.keys())} if self.waiting.exists() else set()

    def _store(self) -> None:
        m = self.now
        self.machine.update((m.state, m.seen, m.used, float(m.floor), float(m.total), float(m.best), m.best_at, m.waited, self.base, self.due, self.since))
        self.powers.update(([float(x) for x in m.window],))
        self.ring.put(self.kept) if self.kept else self.ring.clear()

    def _feed(self, key, seq: int, channels: int, samples: bytes) -> Iterator[Row]:
        """Take the next chunk; the records of pulses that it confirms."""
        cfg, first = self.cfg, self.now.seen
        body = np.frombuffer(samples, "<c8").reshape(-1, channels)
        self.kept.append((seq, first, channels, bytes(samples)))
        found = self.now.step((np.abs(body.astype(np.complex128)) ** 2).sum(axis=1))
        if found:
            start = self.kept[0][1]
            every = np.concatenate([np.frombuffer(x, "<c8").reshape(-1, c) for _, _, c, x in self.kept])
            for at, level, floor, _ in found:
                stop = at + cfg.confirmation + 1
                own = every[max(0, stop - cfg.save_width - start) : stop - start]
                within = next(s for s, f, _, _ in reversed(self.kept) if f <= at)
                pulse_at = len(own) - cfg.confirmation - cfg.pulse_width
                yield Row(site=key[0], band=key[1], peak=self.base + at, seq=within, level=level, floor=floor, channels=channels, pulse_at=pulse_at, pulse_n=cfg.pulse_width, samples=own.tobytes())
        # what a record confirmed by the next chunk could need stays
        while len(self.kept) > 1 and self.kept[1][1] <= self.now.seen - cfg.save_width:
            self.kept.pop(0)

    def _drain(self, key) -> Iterator[Row]:
        while self.due in self.seqs:
            channels, samples = self.waiting.getValue((self.due,))
            self.waiting.removeKey((self.due,))
            self.seqs.remove(self.due)
            self.due += 1
            yield from self._feed(key, self.due - 1, channels, samples)

    def _skip(self, key) -> Iterator[Row]:
        """Give up what is missing: go on with the first chunk that waits."""
        if self.seqs:
            self.base += self.now.seen
            self.due, self.now, self.kept = min(self.seqs), State(self.cfg), []
            yield from self._drain(key)

    def _patient(self, at: int) -> None:
        """A timer runs while chunks wait, and only then."""
        if self.seqs and self.since < 0:
            self.since = at + self.patience
            self.handle.registerTimer(self.since)
        elif not self.seqs and self.since >= 0:
            self.handle.deleteTimer(self.since)
            self.since = -1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        for r in rows:
            if r["seq"] is None or r["samples"] is None or not r["channels"] or r["seq"] < self.due:
                continue  # no chunk, or one that was taken or given up
            if r["seq"] == self.due:
                self.due += 1
                yield from self._feed(key, r["seq"], r["channels"], r["samples"])
            else:
                self.waiting.updateValue((r["seq"],), (r["channels"], bytes(r["samples"])))
                self.seqs.add(r["seq"])
            yield from self._drain(key)
            if len(self.seqs) > self.most:
                yield from self._skip(key)
            self._patient(int(r["at"].timestamp() * 1000))
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.since = -1
        yield from self._skip(key)
        self._patient(timerValues.getCurrentWatermarkInMs())
        self._store()

    def close(self) -> None:
        pass


def pulse_records(chunks: DataFrame, cfg: Detector = Detector(), patience: int = 10_000, most: int = 64, late: str = "10 seconds") -> DataFrame:
    """Records of a stream of chunks (``CHUNKS``: complex64 samples, channels interleaved), one row for each confirmed pulse.

    Chunks that are more than ``late`` behind the newest one count as lost. Needs the state store that keeps typed state:
    ``spark.sql.streaming.stateStore.providerClass`` must name RocksDB's.
    """
    if cfg.save_width < cfg.pulse_width + cfg.confirmation:
        raise ValueError("a record must hold its pulse and what confirms it")
    reach_workers(chunks.sparkSession)
    return chunks.withWatermark("at", late).groupBy("site", "band").transformWithState(PulseRecords(cfg, patience, most), RECORDS, "append", "EventTime")
