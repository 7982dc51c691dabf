import json
import random

import pytest
from pyspark.sql import functions as F

from roadweave.sources import feeds, sinks
from roadweave.streaming import feeds as streams


def docs(spark, *objects):
    return spark.createDataFrame([(i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "n int, doc string")


def test_gbfs(spark):
    stations = {"last_updated": 1, "data": {"stations": [{"station_id": "a", "name": "A", "lat": 38.9, "lon": -77.0, "capacity": 9}, {"station_id": "b", "lat": 99, "lon": 0}, {"station_id": "c", "lat": 0, "lon": 0}, {"name": "no id", "lat": 1, "lon": 1}]}}
    assert [r.station_id for r in feeds.stations(docs(spark, stations, "not json")).collect()] == ["a"]
    status = {"data": {"stations": [{"station_id": "a", "num_bikes_available": 2, "num_docks_available": 3, "is_renting": True}, {"station_id": "b", "num_bikes_available": -1, "num_docks_available": 3}]}}
    assert [(r.station_id, r.is_renting) for r in feeds.station_status(docs(spark, status)).collect()] == [("a", True)]
    bikes = {"data": {"bikes": [{"bike_id": "x", "lat": 1.0, "lon": 1.0, "is_reserved": 0, "is_disabled": False}, {"bike_id": "y", "lat": 1.0, "lon": 1.0, "is_disabled": 1}]}}
    assert [r.bike_id for r in feeds.free_bikes(docs(spark, bikes)).collect()] == ["x"]
    plans = {"data": {"plans": [{"plan_id": "p", "name": "P", "currency": "USD", "price": 1.0, "per_min_pricing": [{"start": 0, "rate": 0.1, "interval": 1}]}, {"plan_id": "q", "price": 2}, {"plan_id": "bad", "price": -1}]}}
    assert [(r.plan_id, r.rate) for r in feeds.pricing(docs(spark, plans)).orderBy("plan_id").collect()] == [("p", 0.1), ("q", None)]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    zones = {"data": {"geofencing_zones": {"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[:2]]]}, "properties": {"name": "z", "rules": [{"ride_allowed": False}]}}]}}}
    assert [(r.name, len(r.ring)) for r in feeds.zones(docs(spark, zones)).collect()] == [("z", 4)]


def test_geojson_weather_and_trains(spark):
    now = F.timestamp_millis(F.lit(5000).cast("long"))
    f = lambda i, a, b: {"id": i, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"start": a, "end": b}}
    assert [r.id for r in feeds.permits(docs(spark, {"features": [f("in", 1000, 9000), f("over", 1000, 2000), f("odd", "x", 9000)]}), now).collect()] == ["in"]
    alert = lambda i, e, a, b: {"id": i, "properties": {"event": e, "onset": a, "ends": b}}
    rows = feeds.weather_alerts(docs(spark, {"features": [alert("1", "Heat", "1970-01-01T00:00:00+00:00", "1970-01-02T00:00:00+00:00"), alert("2", "Fog", "1970-01-01T00:00:00+00:00", "1970-01-02T00:00:00+00:00"), alert("3", "Heat", "bad", "bad")]}), now, ["Heat"])
    assert [r.id for r in rows.collect()] == ["1"]
    rain = {"properties": {"quantitativePrecipitation": {"values": [{"validTime": "2026-01-01T00:00:00+00:00/PT6H", "value": 2.5}, {"validTime": "2026-01-01T06:00:00+00:00/P1DT2H", "value": 0}, {"validTime": "?", "value": 1}]}}}
    assert [(r.hours, r.mm) for r in feeds.rain(docs(spark, rain)).collect()] == [(6, 2.5), (26, 0.0)]
    trains = {"Trains": [{"LocationCode": "A", "Min": "BRD"}, {"LocationCode": "B", "Min": "7"}, {"LocationCode": "C", "Min": "---"}, {"Min": "1"}]}
    assert [(r.LocationCode, r.minutes) for r in feeds.trains(docs(spark, trains)).collect()] == [("A", 0), ("B", 7), ("C", None)]


def test_gpx_and_overrides(spark):
    gpx = '<gpx><trk><trkseg><trkpt lat="38.9" lon="-77.0"><ele> 12.5 </ele></trkpt><trkpt lon="-77.1" lat="38.8"/></trkseg></trk></gpx>'
    assert [(r.n, r.lon, r.lat, r.ele) for r in feeds.track_points(docs(spark, gpx)).collect()] == [(0, -77.0, 38.9, 12.5), (1, -77.1, 38.8, None)]
    doc = {"rows": [{"kind": "stress", "way": 1, "value": "2"}], "groups": [{"kind": "access", "ways": [5, 6], "value": "no"}]}
    rows = feeds.override_rows(docs(spark, doc))
    assert sorted((r.kind, r.way) for r in rows.collect()) == [("access", 5), ("access", 6), ("stress", 1)]
    with pytest.raises(ValueError):
        feeds.checked(rows, spark.createDataFrame([(1,)], "way long"), ["way"], "overrides")


def test_builds_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}/segment"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "way long, name string")
    sinks.write_build(a, root, "b1")
    sinks.promote(spark, root, "b1")
    with pytest.raises(ValueError):
        sinks.write_build(a, root, "b1", live="b1")
    sinks.write_build(a.limit(1), root, "b2", live="b1")
    sinks.promote(spark, root, "b2")
    assert sinks.live_build(spark, root).count() == 1
    assert sinks.pointer(spark, root)["previous"] == "b1"
    assert [r.way for r in sinks.insert_new(spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "way long, name string"), a, ["way"]).collect()] == [3]
    sinks.write_csv(spark.createDataFrame([(1, 'a "b", c')], "id int, t string").coalesce(1), f"file://{tmp_path}/csv", "open licence")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/csv").collect()]
    assert lines[:2] == ["# open licence", "id,t"] and '1,"a ""b"", c"' in lines
    feature = json.loads(sinks.geojson(spark.createDataFrame([(1.0, 2.0, "n")], "lon double, lat double, name string"), "lon", "lat").first().value)
    assert feature["geometry"]["coordinates"] == [1.0, 2.0] and feature["properties"] == {"name": "n"}


def test_vector_tile(spark):
    df = spark.createDataFrame([(1, 0, 0, [(0, 0), (10, 5)], "a", 2), (1, 0, 0, [(4096, 4096), (1, 1)], "b", 3), (1, 1, 0, [(3, 3), (4, 4)], "a", 2)], "z int, x long, y long, points array<struct<x int, y int>>, name string, tier int")
    found = {r.x: bytes(r.tile) for r in sinks.tiles(df, "roads").collect()}
    assert set(found) == {0, 1}

    def varint(b, i):
        n = s = 0
        while True:
            n |= (b[i] & 127) << s
            s += 7
            i += 1
            if b[i - 1] < 128:
                return n, i

    def fields(b):
        i, out = 0, []
        while i < len(b):
            k, i = varint(b, i)
            if k & 7 == 2:
                n, i = varint(b, i)
                out.append((k >> 3, b[i : i + n]))
                i += n
            else:
                v, i = varint(b, i)
                out.append((k >> 3, v))
        return out

    layer = fields(fields(found[0])[0][1])
    assert (1, b"roads") in layer and (5, 4096) in layer and (15, 2) in layer
    features = [fields(v) for k, v in layer if k == 2]
    assert len(features) == 2
    geometry, i, numbers = dict(features[0])[4], 0, []
    while i < len(geometry):
        n, i = varint(geometry, i)
        numbers.append(n)
    assert numbers == [9, 0, 0, 10, 20, 10]


def stream_of(spark, tmp_path, rows, schema, files=3):
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def run(query, name):
    q = query.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_stream_windows_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"2026-01-01T{rng.randrange(24):02d}:{rng.randrange(60):02d}:00", rng.choice("ab")) for _ in range(200)]
    s = stream_of(spark, tmp_path, rows, "ts timestamp, k string")
    run(streams.window_counts(s, "ts", ["k"], "1 hour").writeStream.outputMode("complete"), "windows")
    want = {(r.start, r.k, r.n) for r in streams.window_counts(spark.read.schema("ts timestamp, k string").json(f"{tmp_path}/in"), "ts", ["k"], "1 hour").collect()}
    assert {(r.start, r.k, r.n) for r in spark.table("windows").collect()} == want


def test_stream_state(spark, tmp_path):
    rows = [("f", t, 30) for t in range(1, 6)] + [("f", 6, 2), ("f", 7, 2), ("g", 1, 0)]
    s = spark.createDataFrame(rows, "feed string, at long, found long")
    s.coalesce(1).write.json(f"{tmp_path}/reads")
    stream = spark.readStream.schema("feed string, at long, found long").json(f"{tmp_path}/reads")
    run(streams.remembered(stream).writeStream.outputMode("append"), "reads")
    assert {(r.feed, r.at, r.doubt) for r in spark.table("reads").collect() if r.doubt} == {("f", 6, "shrunk")}
    asks = spark.createDataFrame([("c", 1, 6), ("c", 2, 6), ("c", 3, 4), ("c", 61, 6)], "client string, at long, cost long")
    asks.coalesce(1).write.json(f"{tmp_path}/asks")
    stream = spark.readStream.schema("client string, at long, cost long").json(f"{tmp_path}/asks")
    run(streams.take_if_fits(stream, 10, 60).writeStream.outputMode("append"), "asks")
    assert [(r.at, r.taken) for r in spark.table("asks").orderBy("at").collect()] == [(1, True), (2, False), (3, True), (61, True)]


def test_last_good(spark, tmp_path):
    schema = "id string, v long, at long"
    s = stream_of(spark, tmp_path, [("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], schema, 3)
    q = streams.keep_last_good(s, f"{tmp_path}/good", "id", "at").option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert {(r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/good/2").collect()} == {("a", 2), ("b", 1)}
