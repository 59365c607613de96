import json

import pytest
from pyspark.sql import functions as F

from quakeledger.catalog import canonical
from quakeledger.sources import fdsn, files


def test_canonical_csv(spark, tmp_path):
    (tmp_path / "one.csv").write_text('origin_time,latitude,longitude,depth_km,magnitude,source\n2020-01-01T00:00:00, 1.5 ,2,nan,abc,"x,y"\n,,,,,\n')
    got = files.read_csv(spark, str(tmp_path / "one.csv"))
    r = got.where("origin_time IS NOT NULL").first()
    assert (r["catalog_id"], r["latitude"], r["depth_km"], r["magnitude"], r["source"]) == ("one", 1.5, None, None, "x,y") and got.count() == 2
    (tmp_path / "bad.csv").write_text("latitude\n1\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "empty.csv").write_text("origin_time,latitude,longitude,depth_km,magnitude\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "empty.csv"))


def test_raw_csv_sets_bad_lines_apart(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(" Date ,Time, Lat\n2020-01-01, 10:00:00,1\n2020-01-02,11:00:00\n2020-01-03,12:00:00,3,4\n")
    rows, bad = files.read_raw_csv(spark, str(tmp_path / "raw.csv"))
    assert rows.columns == ["Date", "Time", "Lat"] and rows.count() == 1 and bad.count() == 2


def test_headers():
    assert files.detect_columns(["Date", "Time", "lat"])[1] == ("Date", "Time")
    assert files.detect_columns(["time", "Latitude"])[0]["origin_time"] == "time" and files.detect_columns(["time"])[1] is None
    found, pair = files.detect_columns(["Origin Time", "Date", "Time"])
    assert found["origin_time"] == "Origin Time" and pair is None


def test_prepare(spark):
    raw = spark.createDataFrame([("2020-01-0110:00:00", "'1.5'", "2", "10 mi", "5.6 Mw", ""), ("x", "", "", "5 km", "4", "mb")], "time string, Lat string, LONG string, Depth string, Mag string, magType string")
    a, b = files.prepare(raw, "c").orderBy(F.desc_nulls_last("origin_time")).collect()
    assert str(a["origin_time"]) == "2020-01-01 10:00:00" and a["latitude"] == 1.5 and a["depth_km"] == pytest.approx(16.0934) and (a["magnitude"], a["magnitude_type"]) == (5.6, "Mw")
    assert b["origin_time"] is None and (b["magnitude"], b["magnitude_type"], b["depth_km"]) == (4.0, "mb", 5.0)
    with pytest.raises(ValueError, match="latitude"):
        files.prepare(raw.drop("Lat"), "c")
    assert files.earthquakes_only(spark.createDataFrame([("Earthquake",), ("Blast",)], "Type string")).count() == 1


def test_geojson(spark, tmp_path):
    events = {"features": [{"id": "a", "properties": {"mag": 5.0, "time": 1577836800123, "magType": "mw"}, "geometry": {"coordinates": [10.0, -5.0, 33.0]}}, {"id": "b", "properties": {"mag": None, "time": 1577836800000}, "geometry": {"coordinates": [1.0, 2.0]}}]}
    (tmp_path / "e.json").write_text(json.dumps(events, indent=1))
    got = {r["event_uid_source"]: r for r in files.read_geojson_events(spark, str(tmp_path / "e.json"), "g").collect()}
    assert got["a"]["latitude"] == -5.0 and got["a"]["origin_time"].microsecond == 123000 and got["b"]["depth_km"] is None
    faults = {"features": [{"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"geometry": {"type": "MultiLineString", "coordinates": [[[2, 2]], [[3, 3], [4, 4]]]}}, {"geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}}]}
    (tmp_path / "f.json").write_text(json.dumps(faults))
    got = files.read_geojson_faults(spark, str(tmp_path / "f.json"))
    assert got.count() == 5 and got.select("line").distinct().count() == 3
    (tmp_path / "g.json").write_text("no json")
    assert files.read_geojson_faults(spark, str(tmp_path / "g.json")).count() == 0


def test_quakeml(spark, tmp_path):
    def event(k, body):
        return f'<event publicID="e{k}">{body}</event>'

    origin = '<origin publicID="o{0}"><time><value>2020-01-0{0}T00:00:00.5Z</value></time><latitude><value>{0}</value></latitude><longitude><value>9</value></longitude><depth><value>12000</value></depth></origin>'
    mag = '<magnitude publicID="m{0}"><mag><value>{0}.0</value></mag><type>{1}</type></magnitude>'
    text = "<q:quakeml xmlns:q='http://x'><eventParameters>" + event(1, "<preferredOriginID>o2</preferredOriginID><preferredMagnitudeID>m3</preferredMagnitudeID>" + origin.format(1) + origin.format(2) + mag.format(5, "mb") + mag.format(3, "ml")) + event(2, origin.format(3) + mag.format(6, "mb") + mag.format(4, "Mwc")) + event(3, origin.format(4) + mag.format(4, "mb") + mag.format(6, "ml")) + event(4, mag.format(5, "mb")) + "</eventParameters></q:quakeml>"
    (tmp_path / "q.xml").write_text(text)
    got = {r["event_uid_source"]: (r["latitude"], r["magnitude"], r["depth_km"]) for r in files.read_quakeml(spark, str(tmp_path / "q.xml"), "q").collect()}
    assert got == {"e1": (2.0, 3.0, 12.0), "e2": (3.0, 4.0, 12.0), "e3": (4.0, 6.0, 12.0)}


def test_resumable_append_and_json(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(x, float("nan")) for x in xs], "dataset_id string, score double")
    path = str(tmp_path / "scores")
    assert files.append_new(rows("a", "b"), path) == 2 and files.append_new(rows("b", "c"), path) == 1
    assert spark.read.parquet(path).count() == 3
    assert json.loads(files.as_json(rows("a")).first()["value"]) == {"dataset_id": "a", "score": None}


def test_canonical_needs_its_columns(spark):
    with pytest.raises(ValueError):
        canonical(spark.createDataFrame([], "catalog_id string"))


def fake(url):
    """A service with one event an hour of the first of January 2020."""
    from urllib.parse import parse_qs, urlparse
    from datetime import datetime

    q = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
    a, b = (datetime.fromisoformat(q[k]) for k in ("starttime", "endtime"))
    hours = [h for h in range(24) if a <= datetime(2020, 1, 1, h, 30) < b]
    if "/count" in url:
        return json.dumps({"count": len(hours)})
    return json.dumps({"features": [{"id": f"h{h}", "properties": {"time": f"2020-01-01T{h:02d}:30:00Z", "mag": 4.0}, "geometry": {"coordinates": [1.0, 2.0]}} for h in hours]})


def test_event_service(spark, monkeypatch):
    import sys
    import types

    module = types.ModuleType("fake_service")
    module.fake = fake
    monkeypatch.setitem(sys.modules, "fake_service", module)
    reader = fdsn.EventReader({"url": "http://x", "start": "2020-01-01", "end": "2020-01-02", "max_rows": "5", "fetch": "fake_service:fake"})
    windows = reader.partitions()
    rows = [r for w in windows for r in reader.read(w)]
    assert len(windows) == 8 and sorted(r[0] for r in rows) == sorted(f"h{h}" for h in range(24))
    assert fdsn.boxes(170, 190) == [(170.0, 180.0), (-180.0, -170.0)] and fdsn.boxes(-10, 10) == [(-10, 10)]
    assert reader.is_feasible()
    xml = "<q xmlns='http://x'><event publicID='a'><origin publicID='o'><time><value>2020-01-01T00:00:00Z</value></time><latitude><value>1</value></latitude><longitude><value>2</value></longitude></origin><magnitude publicID='m'><mag><value>5</value></mag><type>mb</type></magnitude><magnitude publicID='n'><mag><value>4.5</value></mag><type>Mww</type></magnitude></event><event publicID='b'/></q>"
    assert [(r[0], r[2], r[4], r[5], r[6]) for r in fdsn.parse_quakeml(xml)] == [("a", 1.0, None, 4.5, "Mww")] and fdsn.parse_quakeml("<") == []
    assert fdsn.compact_box([179.0, -179.0, 178.0], 1.0) == (177.0, 182.0) and fdsn.compact_box([], 1) == (-180.0, 180.0)
    assert fdsn.compact_box([-120.0, -115.0], 0.5) == (-120.5, -114.5)
    calls = []
    assert fdsn.fetch_with_retry("u", get=lambda u: calls.append(u) or 1 / 0, sleep=calls.append) is None and calls == ["u", 2.0, "u", 4.0, "u"]


def test_command_line(spark, tmp_path, capsys):
    from quakeledger import cli

    lines = ["Date,Time,Lat,Lon,Depth,Mag"] + [f"2020-01-{1 + i % 28:02d},{i % 24:02d}:00:{i % 60:02d},{i % 7},{i % 11},{5 + i % 30} km,{3 + (i * 7 % 30) / 10} Mw" for i in range(200)] + ["broken"]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    assert cli.main(["prepare", str(tmp_path / "raw.csv"), str(tmp_path / "clean"), "--catalog", "mine"]) == 0
    assert cli.main(["audit", str(tmp_path / "clean"), "--out", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "1 lines" in said and "mine: " in said
    assert json.loads(spark.read.text(str(tmp_path / "out/verdicts")).first()["value"])["n"] == 200


def _hourly(limit, fail=lambda start, end: False, total=False):
    """A stand-in for a service with an event an hour on one day, that gives at most ``limit`` events."""
    import json
    import urllib.parse
    from datetime import datetime

    def get(url):
        q = dict(urllib.parse.parse_qsl(url.partition("?")[2]))
        a, b = (datetime.fromisoformat(q[k]) for k in ("starttime", "endtime"))
        if fail(a, b):
            raise OSError("no answer")
        hours = [h for h in range(24) if a <= datetime(2020, 1, 1, h, 30) < b]
        if "/count" in url:
            return str(len(hours))
        f = [{"id": f"h{h}", "properties": {"time": f"2020-01-01T{h:02d}:30:00Z", "lat": 1.0, "lon": 2.0, "mag": 4.0}} for h in hours]
        return json.dumps({"metadata": {"totalCount": min(len(hours), limit)}, "features": f[: int(q.get("limit", limit))]})

    return get


def _read(monkeypatch, get, **options):
    import sys
    import types

    module = types.ModuleType("hourly_service")
    module.get = get
    monkeypatch.setitem(sys.modules, "hourly_service", module)
    reader = fdsn.EventReader({"url": "http://x", "start": "2020-01-01", "end": "2020-01-02", "max_rows": "5", "fetch": "hourly_service:get", "pause": "0"} | options)
    return reader, lambda: sorted(r[0] for w in reader.partitions() for r in reader.read(w))


@pytest.mark.parametrize("counts", ["endpoint", "total", "none"])
def test_services_give_all_events_whatever_they_count(monkeypatch, counts):
    reader, rows = _read(monkeypatch, _hourly(5), counts=counts)
    assert reader.is_feasible() and rows() == sorted(f"h{h}" for h in range(24))


def test_a_window_that_fails_is_halved_and_then_an_error(monkeypatch):
    from datetime import timedelta

    _, rows = _read(monkeypatch, _hourly(50, lambda a, b: b - a > timedelta(hours=3)), counts="none")
    assert rows() == sorted(f"h{h}" for h in range(24))
    for counts in ("endpoint", "total", "none"):
        reader, rows = _read(monkeypatch, _hourly(5, lambda a, b: True), counts=counts)
        assert not reader.is_feasible()
        with pytest.raises(fdsn.Incomplete):
            rows()


def test_equal_rows_of_a_file_without_ids_stay(spark, tmp_path):
    from quakeledger.catalog import seconds
    from quakeledger.operators import subtests as st

    line = "2020-01-{:02d}T00:00:00,{},{},10,4.5"
    lines = [line.format(1 + i % 28, i % 50, i % 90) for i in range(60)] + [line.format(1, 0, 0)] * 30
    (tmp_path / "dup.csv").write_text("origin_time,latitude,longitude,depth_km,magnitude\n" + "\n".join(lines))
    cat = files.read_csv(spark, str(tmp_path / "dup.csv")).withColumn("t", seconds())
    assert cat.count() == 90 and cat.select("record_id").distinct().count() == 90
    a5, p7 = st.a5_duplicates(cat).first(), st.p7_timestamps(cat).first()
    assert a5["n_flagged"] == 31 and abs(a5["score"] - (1 - 31 / 90)) < 1e-9
    assert abs(p7["score"] - 28 / 90) < 1e-9


def test_a_field_that_spans_lines_is_read_whole(spark, tmp_path):
    (tmp_path / "m.csv").write_text('origin_time,latitude,longitude,depth_km,magnitude,source\n2020-01-01,1,2,3,4,"a\nb"\n2020-01-02,1,2,3,4,c\n')
    got = sorted(r["source"] for r in files.read_csv(spark, str(tmp_path / "m.csv")).collect())
    assert got == ["a\nb", "c"]
