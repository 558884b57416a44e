"""Pulse files as a source and a stream, quarantine and replay, and records from sample streams."""

import os
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixwave import registry
from fixwave.config import Detector
from fixwave.sources import det, det_source
from fixwave.streaming import detector, quarantine, records

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def content(n=4, at=1_700_000_000.0):
    return det.pack(np.arange(n, dtype=np.complex64).reshape(-1, 1), 1, 2, 8000.0, 150e6, at)


def put(folder, name, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    return path


def tree(folder, sites=("north", "south"), hours=3, minutes=4):
    for s in sites:
        for h in range(hours):
            for m in range(minutes):
                put(folder, f"{s}/2023/11/14/{h:02d}/{m:02d}/ID{m}_10000000.det", content(4 + m))


# the source


def test_source_reads_records_and_errors(spark, tmp_path):
    tree(tmp_path)
    put(tmp_path, "north/2023/11/14/00/00/ID9_20000000.det", b"short")
    put(tmp_path, "north/2023/11/14/00/00/notes.txt", b"not a record")
    put(tmp_path, "north/lost/ID1_10000000.det", content())
    rows = det_source.scan(spark, str(tmp_path), foldersPerTask=5).collect()
    assert len(rows) == 25 and [r["error"] for r in rows if r["tag"] == "ID9"] == ["truncated header"]
    r = next(r for r in rows if r["site"] == "south" and r["minute"] == "2023-11-14 02:03")
    assert (r["tag"], r["channels"], r["pulse_at"], r["pulse_n"], r["timestamp"], len(r["samples"])) == ("ID3", 1, 1, 2, 1_700_000_000.0, 56)
    assert sorted(os.path.basename(r["path"]) for r in det_source.stray(spark, str(tmp_path)).collect()) == ["ID1_10000000.det", "notes.txt"]
    (tmp_path / "none").mkdir()
    assert det_source.scan(spark, str(tmp_path / "none")).count() == 0


def test_filters_choose_the_folders(spark, tmp_path, monkeypatch):
    tree(tmp_path)
    df = det_source.scan(spark, str(tmp_path))
    some = df.where("site = 'north' AND minute >= '2023-11-14 01:02' AND minute < '2023-11-14 02:01'")
    assert sorted(r["minute"][-5:] for r in some.collect()) == ["01:02", "01:03", "02:00"]
    assert df.where(F.col("site").isin("south", "east") & (F.col("minute") == "2023-11-14 00:01")).count() == 1
    # a session that pushes nothing down has options, and filters what was read
    plain = det_source.scan(spark, str(tmp_path), pushdown="false", sites="north,east", high="2023-11-14 01:00")
    assert plain.count() == 5 and plain.where("minute > '2023-11-14 00:02'").count() == 2
    # folders out of range aren't entered
    entered, listed = [], det_source._listed
    monkeypatch.setattr(det_source, "_listed", lambda store, folder: entered.append(folder) or listed(store, folder))
    reader = det_source.DetReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    rest = list(reader.pushFilters([EqualTo(("site",), "north"), GreaterThanOrEqual(("minute",), "2023-11-14 02:02"), StringContains(("tag",), "I")]))
    assert len(rest) == 1 and [f for p in reader.partitions() for f in p.folders] == [("north", "2023-11-14 02:02"), ("north", "2023-11-14 02:03")]
    assert not any("south" in f or f.endswith("/01") or f.endswith("/00") for f in entered)


def run(stream, folder, log):
    query = stream.writeStream.format("parquet").option("path", str(folder)).option("checkpointLocation", str(log)).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_stream_admits_the_newest_folders_of_each_site(spark, tmp_path):
    tree(tmp_path / "in")
    for k in range(4):
        run(det_source.stream(spark, str(tmp_path / "in"), str(tmp_path / "ledger"), throttle=5), tmp_path / "out", tmp_path / "log")
        got = [(r["site"], r["minute"][-5:]) for r in spark.read.schema(det_source.SCHEMA).parquet(str(tmp_path / "out")).collect()]
        assert len(got) == len(set(got))  # none twice
        if k == 0:
            assert sorted(got) == [(s, m) for s in ("north", "south") for m in ("01:03", "02:00", "02:01", "02:02", "02:03")]
            put(tmp_path / "in", "north/2023/11/14/02/30/ID5_10000000.det", content())  # newer than what is left
        if k == 1:
            assert ("north", "02:30") in got and len(got) == 20
    assert len(got) == 25
    now = time.strftime("%Y/%m/%d/%H/%M", time.gmtime())
    put(tmp_path / "in", f"north/{now}/ID5_10000000.det", content())  # may still grow
    assert det_source.DetStreamReader({"path": str(tmp_path / "in"), "ledger": str(tmp_path / "ledger")}).latestOffset() == det_source.DetStreamReader({"path": str(tmp_path / "in"), "ledger": str(tmp_path / "ledger")}).latestOffset()


def test_admissions_survive_a_stop_before_the_offset_is_logged(tmp_path):
    tree(tmp_path / "in", sites=("north",))
    options = {"path": str(tmp_path / "in"), "ledger": str(tmp_path / "ledger"), "throttle": "5"}
    first = det_source.DetStreamReader(options)
    assert first.latestOffset() == {"admitted": 1}
    again = det_source.DetStreamReader(options)  # the driver is another process now
    end = again.latestOffset()
    found = [f for p in again.partitions({"admitted": 0}, end) for f in p.folders]
    assert len(found) == len(set(found)) == 10 and [f for p in again.partitions({"admitted": 0}, {"admitted": 1}) for f in p.folders] == found[:5]


# quarantine


def test_quarantine_is_repaired_and_replayed_once(spark, tmp_path):
    tree(tmp_path / "in", hours=1)
    bad = put(tmp_path / "in", "north/2023/11/14/00/07/ID7_10000000.det", content()[:20])
    worse = put(tmp_path / "in", "south/2023/11/14/00/07/ID8_10000000.det", b"\0")
    put(tmp_path / "in", "nowhere/2023/11/14/00/07/ID6_10000000.det", content())
    put(tmp_path / "in", "x/1/2/3/4/5/ID0_10000000.det", content())
    sites = spark.createDataFrame([("north",), ("south",)], "name string")
    store, pattern = str(tmp_path / "store"), str(tmp_path / "in/*/*/*/*/*/*")
    assert quarantine.landed(spark, store, "records") is None and quarantine.still_open(spark, store).count() == 0
    quarantine.land(spark, quarantine.files(spark, pattern, most=5), store, sites, str(tmp_path / "log"))
    assert quarantine.landed(spark, store, "records").count() == 8
    left = {r["name"]: r["error"] for r in quarantine.still_open(spark, store).collect()}
    assert left == {"ID7_10000000.det": "truncated header", "ID8_10000000.det": "truncated header", "ID6_10000000.det": "unknown site", "ID0_10000000.det": "not in a minute folder of a site"}
    quarantine.land(spark, quarantine.files(spark, pattern, most=5), store, sites, str(tmp_path / "log"))  # nothing new
    assert quarantine.landed(spark, store, "records").count() == 8 and bad.exists() and worse.exists()
    # one file is repaired where it was handed out, and replayed three times: as it is, touched, and as a copy
    held = tmp_path / "held"
    assert quarantine.hand_out(quarantine.still_open(spark, store), str(held)) == 3
    mended = held / "north_2023.11.14.00.07" / "ID7_10000000.det"
    assert mended.read_bytes() == content()[:20]
    for body in (content(6), content(6), content(9)):
        time.sleep(1.1)  # a file counts as new by its time
        mended.write_bytes(body)
        quarantine.replay(spark, quarantine.files(spark, str(held / "*")), store, sites, str(tmp_path / "log2"))
    done = quarantine.landed(spark, store, "records")
    assert done.count() == 9 and [len(r["samples"]) for r in done.where("run = 'replay'").collect()] == [48]
    assert sorted(r["name"][:3] for r in quarantine.still_open(spark, store).collect()) == ["ID0", "ID6", "ID8"]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    """A batch that stopped before its mark is run again with the same files."""
    rows = spark.createDataFrame([(f"/q/north_2023.11.14.00.0{k}/ID{k}_10000000.det", bytearray(content())) for k in range(3)], "path string, content binary")
    rows.write.parquet(str(tmp_path / "in"))
    sites, store = spark.createDataFrame([("north",)], "name string"), str(tmp_path / "store")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    quarantine.replay(spark, stream(), store, sites, str(tmp_path / "log"))
    for f in (tmp_path / "log/commits").glob("*0*"):  # as if the driver had gone before the batch was logged as done
        f.unlink()
    quarantine.replay(spark, stream(), store, sites, str(tmp_path / "log"))
    assert quarantine.landed(spark, store, "records").count() == 3


def test_files_of_finished_batches_are_archived(spark, tmp_path):
    tree(tmp_path / "in", sites=("north",), hours=1)
    sites, store = spark.createDataFrame([("north",)], "name string"), str(tmp_path / "store")
    for _ in range(2):
        quarantine.land(spark, quarantine.files(spark, str(tmp_path / "in/*/*/*/*/*/*"), str(tmp_path / "kept"), most=1), store, sites, str(tmp_path / "log"))
    for _ in range(50):
        if len(list((tmp_path / "kept").rglob("*.det"))) >= 3:
            break
        time.sleep(0.2)
    assert len(list((tmp_path / "kept").rglob("*.det"))) >= 3 and quarantine.landed(spark, store, "records").count() == 4


# records from streams

CFG = Detector(pulse_width=8, save_width=24, rise=1.3, time_constant=60, confirmation=4)


START = datetime(2024, 1, 1, tzinfo=UTC)


def samples(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, 2)) + 1j * rng.normal(size=(n, 2))).astype(np.complex64)
    for at in range(200, n - 100, 370):
        x[at : at + 8] += 3
    return x


def chunked(x, size, lost=()):
    return [("s", 1, k, START + timedelta(seconds=k), 2, bytearray(x[a : a + size].tobytes())) for k, a in enumerate(range(0, len(x), size)) if k not in lost]


def streamed(spark, tmp_path, batches, **options):
    session = spark.newSession()
    session.conf.set(PROVIDER, ROCKS)
    for k, rows in enumerate(batches):
        session.createDataFrame(rows, records.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            stream = session.readStream.schema(records.CHUNKS).parquet(str(tmp_path / "in"))
        query = records.pulse_records(stream, CFG, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        yield session.read.schema(records.RECORDS).parquet(str(tmp_path / "out")).orderBy("peak").collect()


def test_records_have_the_samples_of_their_pulses(spark, tmp_path):
    x = samples()
    want = detector.detect(x, CFG)
    parts = chunked(x, 7)
    order = parts[:100] + parts[200:300] + parts[100:200] + parts[300:]  # a stretch comes late
    *_, got = streamed(spark, tmp_path, [order[:150], order[150:320], order[320:]], most=1000, late="1000 seconds")
    assert [r["peak"] for r in got] == [w[0] for w in want] and len(got) > 5
    for r, w in zip(got, want):
        stop = w[0] + CFG.confirmation + 1
        assert bytes(r["samples"]) == x[stop - CFG.save_width : stop].tobytes() and r["seq"] == w[0] // 7
        assert (r["channels"], r["pulse_at"], r["pulse_n"]) == (2, 24 - 8 - 4, 8) and abs(r["level"] - w[1]) < 1e-5


def test_lost_chunks_are_given_up_and_peaks_stay_unique(spark, tmp_path):
    x = samples()
    parts = chunked(x, 100, lost=(9, 20))
    *_, got = streamed(spark, tmp_path, [parts], most=3)
    peaks = [r["peak"] for r in got]
    assert len(set(peaks)) == len(peaks) > 4
    runs, base, want = [x[:900], x[1000:2000], x[2100:]], 0, []
    for part in runs:
        want += [base + p[0] for p in detector.detect(part, CFG)]
        base += len(part)
    assert peaks == want


def test_a_timer_ends_the_wait_for_a_lost_chunk(spark, tmp_path):
    x = samples()
    parts = chunked(x, 100, lost=(9,))
    other = [("t", 1, 0, START + timedelta(seconds=300), 2, bytearray(x[:100].tobytes()))]
    first, second = streamed(spark, tmp_path, [parts, other], patience=60_000)
    # time goes on by the rows of any stream
    assert all(r["peak"] < 900 for r in first) and any(r["peak"] > 900 for r in second)


@pytest.mark.parametrize("size", [1, 100, 1024, 10_000])
def test_batches_may_end_anywhere(spark, size):
    """Null keys fill whole batches, and a null key may stand alone."""
    power = np.abs(samples(1500)[:, 0].astype(complex)) ** 2
    want = [w[0] for w in detector.State(CFG).step(power)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, size)
        for names in (("a", None), (None,), ("a", "b")):
            rows = spark.createDataFrame([(k, i, float(p)) for k in names for i, p in enumerate(power)], "k string, i long, p double").repartition(3)
            found = detector.detect_ordered(rows, "k", "i", "p", CFG).collect()
            assert {k: sorted(r["peak"] for r in found if r["k"] == k) for k in names} == dict.fromkeys(names, want)
    finally:
        spark.conf.set(key, before)
    assert detector.detect_ordered(rows.limit(0), "k", "i", "p", CFG).count() == 0


def test_records_of_events_are_the_detectors_pulses(spark, sf):
    found = registry.queries()["r_records"](spark, sf).select("site", "peak").collect()
    want = registry.queries()["r_detector"](spark, sf).select("event_type", "peak").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))
