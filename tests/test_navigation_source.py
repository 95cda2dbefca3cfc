import json

from deepledger.sources.navigation_source import read_navigation_files

FILES = {
    "a.csv": "﻿Timestamp, Lat ,Lon,extra,file\n2026-01-01T10:00:00,17.44,78.38,\"x,\ny\",z\n2026-01-01T10:00:10,,\nno,95.0,78.38\n",
    "b.txt": "utc,lng,latitude,hdg\n2026-01-01T10:00:00,78.5,17.5,90\n",
    "utm.csv": "lat,lon,pos.crs\n5761511.4,500000,EPSG:32632\n1,2,EPSG:2154\n",
    "c.geojson": json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:4326"}}, "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [78.1, 17.1]}, "properties": {"Time": 1767261600, "heading": 12.5}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {}}, None, {"type": "Feature", "geometry": None},
    ]}, indent=1),
    "lines.json": '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"time":"2026-01-01T10:00:00"}}\n\n{"type":"Point","coordinates":[3,4]}\n',
    "d.gpx": '<gpx xmlns="urn:x"><wpt lat="1" lon="2"/><trk><trkseg><trkpt lat="17.2" lon="78.2" course="45"><ele>3</ele><time>2026-01-01T10:00:00</time><speed>2.5</speed></trkpt><trkpt lat="17.3"/></trkseg></trk></gpx>',
    "sniffed": '  [\n{"type":"Feature"}]',
    "sniffed.dat": ' {"type":"Point","coordinates":[5,6]}',
    "plain.log": "lat,lon\n7,8\n",
    "track.csv": "", "t.geojson": "not json", "t.json": "[]", "half.json": '{"type":"Point","coordinates":[3,4]}\n{"type":', "t.gpx": "<gpx><wpt lat='1' lon='2'/><broken", "none.gpx": "<gpx/>", "t.xyz": "x", "cols.csv": "a,b\n1,2\n", "head.csv": "lat,lon\n",
    "sub/e.csv": "lat,lon\n9,10\n", ".hidden.csv": "lat,lon\n0,0\n", "_tmp/f.csv": "lat,lon\n0,0\n",
}


def test_folder_of_mixed_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = read_navigation_files(spark, str(tmp_path)).orderBy("file", "position").collect()
    of = lambda name: [r for r in rows if r["file"] == f"{tmp_path}/{name}"]
    spots = lambda name: [(r["latitude"], r["longitude"]) for r in of(name)]
    assert spots("a.csv") == [(17.44, 78.38), (None, None), (95.0, 78.38)] and [r["ts"] is None for r in of("a.csv")] == [False, False, True]
    assert spots("b.txt") == [(17.5, 78.5)] and of("b.txt")[0]["heading_deg"] == 90
    assert abs(spots("utm.csv")[0][0] - 52.0) < 0.01 and abs(spots("utm.csv")[0][1] - 9.0) < 1e-6 and spots("utm.csv")[1] == (None, None)
    assert spots("c.geojson") == [(17.1, 78.1)] and of("c.geojson")[0]["ts"].year == 2026 and of("c.geojson")[0]["heading_deg"] == 12.5
    assert spots("lines.json") == [(2, 1), (4, 3)]
    assert spots("d.gpx") == [(1, 2), (17.2, 78.2)] and [r["warning"] for r in of("d.gpx")] == [None, "speed in m/s, not accuracy: 2.5"] and of("d.gpx")[1]["heading_deg"] == 45 and of("d.gpx")[1]["altitude_m"] == 3
    assert spots("sniffed.dat") == [(6, 5)] and of("sniffed.dat")[0]["format"] == "geojson" and spots("plain.log") == [(7, 8)] and spots("sub/e.csv") == [(9, 10)]
    reason = {name: [r["warning"] for r in of(name)] for name in FILES if of(name) and of(name)[0]["position"] is None}
    table, points, gpx = "no usable lat/lon columns found in CSV", "no Point features found in GeoJSON", "no trkpt/rtept/wpt elements found in GPX"
    assert reason == {
        "track.csv": [table], "cols.csv": [table], "head.csv": [table], "t.geojson": [points], "t.json": [points], "half.json": [points], "t.gpx": [gpx], "none.gpx": [gpx],
        "t.xyz": ["unsupported navigation file (use CSV, GeoJSON or GPX)"], "sniffed": ["unsupported navigation file (use CSV, GeoJSON or GPX)"],
    }
    assert not of(".hidden.csv") and not of("_tmp/f.csv")


def test_one_file_long_fields_and_no_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("lat,lon,source\n1,2," + "x" * 300_000 + "\n")
    assert [len(r["source"]) for r in read_navigation_files(spark, str(tmp_path / "one.csv")).collect()] == [300_000]
    (tmp_path / "empty").mkdir()
    assert read_navigation_files(spark, str(tmp_path / "empty")).count() == 0
