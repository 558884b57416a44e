"""Helpers that no query covers, against plain Python."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from fixwave import registry
from fixwave.functions import geo
from fixwave.operators import bands, direction
from fixwave.plans.registry import table
from fixwave.sources import exports, tables
from fixwave.streaming import batches


def test_tunings_cover_all_frequencies():
    got = bands.cover([150.1, 150.4, 151.0, 151.9, 155.0], 0.5, 0.6)
    assert all(min(abs(f - t) for t in got) <= 0.6 for f in (150.1, 150.4, 151.0, 151.9, 155.0)) and len(got) == 3
    assert bands.cover([], 1.0, 1.0) == []
    with pytest.raises(ValueError):
        bands.cover([0.5], 1.0, 0.2)


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 30), ("a", 200), ("b", 10), ("a", 5000)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = batches.session_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["k"], r["start"].timestamp() % 86400, r["n"]) for r in spark.table("sessions").collect())
    assert [(k, n) for k, _, n in got] == [("a", 2), ("a", 1), ("b", 1)]  # the last session may go on


def test_colours_are_checksums(spark, sf):
    names = {r["c_custkey"]: r["c_name"] for r in table(spark, sf, "customer").collect()}
    got = {r["c_custkey"]: r["colour"] for r in registry.queries()["x_crc32_colour"](spark, sf).collect()}
    assert got == {k: zlib.crc32(n.encode()) % 12 for k, n in names.items()}


def test_json_rows_hold_the_values(spark, sf):
    rows = {r["o_orderkey"]: r for r in table(spark, sf, "orders").withColumn("t", F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).collect()}
    got = [json.loads(r["value"]) for r in registry.queries()["k_json"](spark, sf).collect()]
    assert len(got) == len(rows) and all(g["o_totalprice"] == rows[g["o_orderkey"]]["o_totalprice"] and g["o_orderdate"] == rows[g["o_orderkey"]]["t"] for g in got)


def test_stated_schemas_and_tables_by_schema(spark, tmp_path):
    stated = exports.stated(spark)
    assert stated.where("is_key").count() > 10 and stated.where("column = 'deploymentID'").count() > 3
    spark.createDataFrame([(1, "north")], "ID long, name string").write.parquet(str(tmp_path / "site"))
    row = tables.read_table(spark, str(tmp_path / "site"), "site").first()
    assert (row["ID"], row["name"]) == (1, "north")
    assert exports.catalogue({"site": spark.read.parquet(str(tmp_path / "site"))}).where("column = 'name'").first()["position"] == 2


def test_site_list(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("name,comp_ip,power_ip,comp_outlet,rx_outlet,powertype,state,auto,schedule\nsite1,localhost,,-1,-1,nil,active,auto,00:00-24:00\nsite2,192.0.2.1,192.0.2.2,1,2,kind,down,manual,18:00-7:30\n,,,,,,,,\nsite3,192.0.2.3,,x,,,, ,never\n")
    got = {r["name"]: r for r in tables.site_list(spark, str(tmp_path / "sites.csv")).collect()}
    assert set(got) == {"site1", "site2", "site3"}
    one, two, three = (got[f"site{k}"] for k in (1, 2, 3))
    assert (one["comp_outlet"], one["powertype"], one["has_power"], one["is_auto"], one["opens"], one["closes"]) == (None, None, False, True, 0, 1440)
    assert (two["comp_outlet"], two["rx_outlet"], two["powertype"], two["has_power"], two["is_auto"], two["opens"], two["closes"]) == (1, 2, "kind", True, False, 1080, 450)
    assert (three["comp_outlet"], three["state"], three["has_power"], three["is_auto"], three["opens"]) == (None, None, False, False, None)


def test_steering_of_a_calibration(spark):
    names = [f"sv{c}{p}" for c in range(1, 5) for p in "ri"]
    rows = [(site, cal, float(b), *[float(cal * 1000 + b + k) for k in range(8)]) for site in (1, 2) for cal in (5, 6) for b in range(360)]
    rows += [(3, 5, 0.0, *[0.0] * 8)]
    df = spark.createDataFrame(rows, "siteID long, cal_infoID long, bearing double, " + ", ".join(f"{n} double" for n in names))
    got = {r["site"]: r for r in direction.steering_of(df, 6).collect()}
    assert set(got) == {1, 2} and got[2]["sv_re"][:5] == [6000.0, 6002.0, 6004.0, 6006.0, 6001.0] and len(got[1]["sv_im"]) == 1440
    assert [r["site"] for r in direction.steering_of(df, 5, [2]).collect()] == [2]
    with pytest.raises(Exception, match="bearings are missing for site 3"):
        direction.steering_of(df, 5).collect()


def test_projected_coordinates_that_are_known(spark):
    """On the central meridian the northing is the meridian arc; on the equator the easting is known; and a well-known tower."""
    points = [(45.0, 3.0, 500000.0, 4982950.400, 31), (0.0, 0.0, 166021.443, 0.0, 31), (48.85824, 2.2945, 448251.8, 5411932.7, 31), (-45.0, 3.0, 500000.0, 10000000 - 4982950.400, 31)]
    df = spark.createDataFrame([p[:2] for p in points], "lat double, lon double")
    east, north, zone = geo.to_utm(F.col("lat"), F.col("lon"))
    got = df.select(east.alias("e"), north.alias("n"), zone.alias("z")).collect()
    for r, (_, lon, e, n, z) in zip(got, points):
        near = 20 if lon == 2.2945 else 0.01
        assert abs(r["e"] - e) < near and abs(r["n"] - n) < near and r["z"] == z
    back = df.withColumns({"e": east, "n": north, "z": zone}).select(*[c.alias(k) for k, c in zip(("y", "x"), geo.from_utm(F.col("e"), F.col("n"), F.col("z"), F.col("lat") < 0))]).collect()
    assert all(abs(r["y"] - p[0]) < 1e-8 and abs(r["x"] - p[1]) < 1e-8 for r, p in zip(back, points))
