"""Inserts, readers of exported files, and calibration on small fixtures."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixwave.operators import access, direction, pieces, windows
from fixwave.sources import inserts, sinks, tables


def test_rows_of_another_width_are_refused(spark):
    assert inserts.table_of(spark, ["a", "b c"], [(1, None), ("x", 2.5)]).collect()[1]["b c"] == "2.5"
    with pytest.raises(ValueError):
        inserts.table_of(spark, ["a", "b"], [(1, 2), (3,)])


def test_complex_literals(spark):
    given = ["(0.1-2e-05j)", "1j", "3", "-1e-05-0j", " (1.5e+03+2.j) ", "-4.25j", "1e-05j", ""]
    want = [complex(x.strip()) if x.strip() else 0j for x in given]
    df = spark.createDataFrame(list(enumerate(given)), "k int, x string")
    re, im = tables.complex_parts(F.col("x"))
    assert [complex(r.a, r.b) for r in df.select("k", re.alias("a"), im.alias("b")).orderBy("k").collect()] == want


def test_signal_and_steering_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {}
    for site in (4, 9):
        z = rng.normal(size=(5, 20)) + 1j * rng.normal(size=(5, 20))
        made[site] = z
        lines = [",".join([str(k), str(100.5 + k), "2.0", "0.5", *map(str, z[k])]) for k in range(5)]
        (tmp_path / f"sig{site}.csv").write_text("id,t,edsp,tnp,...\n" + "\n".join(lines) + "\n")
    got = tables.read_signal_files(spark, {s: str(tmp_path / f"sig{s}.csv") for s in made}).orderBy("siteID", "ID").collect()
    assert len(got) == 10 and got[0].siteID == 4 and got[9].timestamp == 104.5
    assert [complex(got[7][f"nc23r"], got[7]["nc23i"])] == [made[9][2][4 + 6]]
    assert complex(got[3].ed4r, got[3].ed4i) == made[4][3][3]
    (tmp_path / "sv1.csv").write_text("site,id,bearing,sv\n4,7,12.5,(1+0j),1j,(0.5-0.5j),-1j\n")
    (row,) = tables.read_steering_file(spark, str(tmp_path / "sv1.csv")).collect()
    assert (row.siteID, row.ID, row.bearing, row.sv3r, row.sv3i, row.sv4i) == (4, 7, 12.5, 0.5, -0.5, -1.0)


def test_transmitters(spark):
    rows = inserts.table_of(spark, ["name", "use", "frequency", "pulse_width", "rise_trigger", "filter_alpha", "type"], [("a", "Yes", 164.5, 20, 1.1, 0.01, "Pulse"), ("b", "no", 1, 1, 1, 1, "pulse"), ("c", "y", 150, 20, 1.1, 0.01, "other"), ("d", None, 1, 1, 1, 1, "?")])
    got = {r.name: (r.frequency, r.type) for r in tables.transmitters(rows).collect()}
    assert got == {"a": (164.5, "pulse"), "c": (150.0, "continuous")}
    with pytest.raises(PySparkException):
        tables.transmitters(rows.drop("use")).collect()


def test_gps_is_replaced_appended_or_refused(spark):
    track = spark.createDataFrame([(1, 38.5, -121.7, 10.0), (2, -38.5, -121.7, 11.0)], "t int, lat double, lon double, ele double")
    base = inserts.insert_gps(spark.createDataFrame([(8, 5)], "deploymentID long, timestamp int").select("deploymentID", "timestamp", *[F.lit(0.0).alias(c) for c in ("latitude", "longitude", "elevation", "easting", "northing")], F.lit("10S").alias("zone")), track, 7)
    assert base.count() == 3 and {r.zone for r in base.where("deploymentID = 7").collect()} == {"10S", "10H"}
    assert inserts.insert_gps(base, track, 7, "replace").count() == 3
    assert inserts.insert_gps(base, track, 7, "append").count() == 5
    with pytest.raises(ValueError):
        inserts.insert_gps(base, track, 7)


def _given(spark):
    bearings = spark.createDataFrame([(1, s, t, 90.0, 1.0, 0.5, 2, [10 * s, 10 * s + 1]) for t in (30.0, 60.0, 90.0) for s in (1, 2)], "deploymentID long, siteID long, timestamp double, bearing double, likelihood double, activity double, number_est_used int, est_ids array<long>")
    positions = spark.createDataFrame([(1, 30.0, 500000.0, 4262000.0, 1.0, 0.5, 4), (1, 60.0, None, None, None, None, 4)], "deploymentID long, timestamp double, easting double, northing double, likelihood double, activity double, number_est_used int")
    covariances = spark.createDataFrame([(1, 30.0, "ok"), (1, 60.0, "undefined")], "deploymentID long, timestamp double, status string")
    return inserts.positions_batch(bearings, positions, covariances, 5, (10, "S"), {"bearing": 100})


def test_a_batch_of_positions(spark):
    out = _given(spark)
    assert sorted(r.ID for r in out["bearing"].collect()) == [101, 102, 103, 104]  # the window at 90 s has no position row at all
    (p,) = out["position"].collect()
    assert p.ID == 1 and abs(p.latitude - 38.507) < 0.01 and abs(p.longitude + 123) < 1e-6
    assert [tuple(r) for r in out["covariance"].collect()] == [("ok", 1)]
    made = {tuple(r) for r in out["provenance"].collect()}
    assert {("position", 1, "bearing", 101), ("position", 1, "bearing", 102), ("bearing", 104, "est", 21), ("bearing", 103, "calibration_information", 5)} <= made
    assert len(made) == 4 * 2 + 4 + 2


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    out, folder = _given(spark), str(tmp_path / "store")
    inserts.commit(out, folder, 1)
    inserts.commit(out, folder, 1)  # again: replaces itself
    out["bearing"].write.mode("overwrite").parquet(f"{folder}/bearing/batch=2")  # a writer that was lost before its mark
    assert inserts.committed(spark, folder, "bearing").count() == 4
    assert inserts.committed(spark, folder, "provenance").count() == 14


def test_active_deployments_first(spark):
    df = spark.createDataFrame([(1, 5, False, False), (2, 5, True, None), (3, 5, True, True), (4, 6, True, False)], "ID int, projectID int, is_active boolean, is_hidden boolean")
    assert [r.ID for r in access.active_first(df, 5).collect()] == [2, 1]
    assert access.exists(df) and not access.exists(df.where("ID > 9"))


def test_cloud_of_points_comes_in_parts(spark):
    df = spark.range(2500).select(F.lit("a&b").alias("name"), "id", F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    parts = sinks.kml_cloud(df, "name", "id", "lon", "lat").collect()
    assert len(parts) == 3 and sum(r.kml.count("<Point>") for r in parts) == 2500 and all("a&amp;b" in r.kml for r in parts)


def test_wedges_are_open_and_round(spark):
    v = np.array([1.0, 0.5j, -0.5, 0.25])
    v = v / np.linalg.norm(v)
    turned = lambda k: v * np.exp(1j * k)  # noqa: E731  a common phase doesn't matter
    rows = [(1, float(b), *[float(x) for z in turned(k) for x in (z.real, z.imag)]) for k, b in enumerate([359.5, 0.25, 0.75, 2.0])]
    df = spark.createDataFrame(rows, "site int, bearing double, " + ", ".join(f"ed{c}{p} double" for c in range(1, 5) for p in "ri"))
    got = {r.bearing: r for r in direction.wedge_calibration(df, 4.0, 1).collect()}
    assert {b: r.n for b, r in got.items()} == {358: 1, 359: 3, 0: 3, 1: 4, 2: 3, 3: 1}  # 2.0 is not within 2 of 0 or 4, both ends open
    assert np.allclose([complex(got[1][f"sv{c}r"], got[1][f"sv{c}i"]) for c in range(1, 5)], v, atol=1e-9)
    assert direction.wedge_calibration(df, 4.0).count() == 0


@pytest.mark.parametrize("wanted", [1, 7, 300])
def test_pieces_keep_the_order_of_keys(spark, wanted):
    rng = np.random.default_rng(wanted)
    values = [(None if k % 50 == 0 else "xyz"[int(rng.integers(3))], float("nan") if k % 60 == 0 else float(rng.integers(40)), k) for k in range(500)]
    df = spark.createDataFrame(values, "g string, v double, k int").repartition(5)
    got = pieces.split(df, ["g", "v"], wanted).orderBy("g", "v").collect()
    place = [r["__piece"] for r in got]
    assert place == sorted(place) and (len(set(place)) > 3) == (wanted > 1)
    assert len({(r.g, str(r.v)) for r in got}) == len({(r.g, str(r.v), r["__piece"]) for r in got})  # equal keys share a piece


def test_numbers_neighbours_and_sums_cross_pieces(spark):
    rng = np.random.default_rng(1)
    data = [(None if k % 3 == 0 else "a", int(t), k) for k, t in enumerate(rng.permutation(400))]
    df = spark.createDataFrame(data, "g string, t int, k int").repartition(6)
    rows = pieces.split(df, ["g", "t"], 40)
    rows = pieces.running_sum(pieces.previous(rows, ["g"], ["t"], ["k"], "before"), ["g"], ["t"], "k", "upto")
    rows = rows.withColumn("some", F.expr("case when k % 11 = 0 then k end"))
    rows = pieces.around(rows, ["g"], "t", "some", "a", "b")
    number = {r.k: r["__i"] for r in pieces.numbered(df, ["g"], ["t"]).collect()}
    got = {r.k: r for r in rows.collect()}
    assert len(got) == len(number) == 400
    for g in (None, "a"):
        own = sorted((t, k) for x, t, k in data if x == g)
        total = 0
        for i, (t, k) in enumerate(own):
            total += k
            before, after = [q for _, q in own[: i + 1] if q % 11 == 0], [q for _, q in own[i:] if q % 11 == 0]
            r = got[k]
            assert (number[k], r.upto) == (i, total) and (r.before.k if r.before else None) == (own[i - 1][1] if i else None)
            assert (r.a, r.b) == (before[-1] if before else None, after[0] if after else None)


def test_ordered_operators_take_empty_tables_and_one_time(spark):
    none = spark.createDataFrame([], "g string, t long, x double, y double, id long")
    same = spark.createDataFrame([("a", 5, 1.0, 2.0, k) for k in range(20)], none.schema)
    for df, n in ((none, 0), (same, 20)):
        assert windows.sessions(df, ["g"], "t", 5).count() == min(n, 1)
        assert windows.movement(df, ["g"], "t", "x", "y", "id").count() == n
        assert windows.row_windows(df, ["g"], "t", 8, 2, "id").select("id").distinct().count() == n
        assert sorted(r.ID for r in sinks.assign_ids(df, "ID", 9, ["t", "id"]).collect()) == list(range(10, 10 + n))
        assert [r.n_ahead for r in windows.ahead(df, ["g"], "t", 3).collect()] == [n] * n
