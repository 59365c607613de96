import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from quakeledger.operators.timestamps import build_zone, layout_of, normalise, zone_tables, zone_version

ZONES = ("UTC", "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "Europe/Athens", "Atlantic/Azores")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*args):
    return (datetime(*args, tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1)


@pytest.mark.parametrize("name", ZONES)
def test_zone_tables_agree_with_the_standard_library(name):
    zone, ref = build_zone(name), ZoneInfo(name)
    rng = random.Random(5)
    for _ in range(400):
        t = datetime(rng.randrange(1905, 2095), rng.randrange(1, 13), rng.randrange(1, 28), rng.randrange(24), rng.randrange(60), tzinfo=timezone.utc)
        i = np.searchsorted(zone.starts, (t - EPOCH) // timedelta(microseconds=1), side="right") - 1
        assert zone.offsets[i] == t.astimezone(ref).utcoffset() // timedelta(microseconds=1)


CASES = [
    ("2012-01-05T16:21:50.619638779Z", "UTC", "dmy", us(2012, 1, 5, 16, 21, 50, 619638)),
    ("20120105163700", "America/New_York", "dmy", us(2012, 1, 5, 21, 37)),
    ("01/05/2012 08:51:34", "UTC", "mdy", us(2012, 1, 5, 8, 51, 34)),
    ("01/05/2012 08:51:34", "UTC", "dmy", us(2012, 5, 1, 8, 51, 34)),
    ("31.01.2012 08:51", "UTC", "dmy", us(2012, 1, 31, 8, 51)),
    ("31.01.2012 08:51", "UTC", "mdy", None),
    ("2012-01-0723:09:59", "UTC", "dmy", us(2012, 1, 7, 23, 9, 59)),
    ("2012-008T10:17:40Z", "UTC", "dmy", us(2012, 1, 8, 10, 17, 40)),
    ("2012 366 10:17:40", "UTC", "dmy", us(2012, 12, 31, 10, 17, 40)),
    ("2013-366T10:17:40Z", "UTC", "dmy", None),
    ("2012-01-05 20:54:14,5 UTC", "America/New_York", "dmy", us(2012, 1, 5, 20, 54, 14, 500000)),
    ("2012-01-06T01:19:46-01", "Europe/Athens", "dmy", us(2012, 1, 6, 2, 19, 46)),
    ("2012-01-06T07:32:29+02:00[Europe/Athens]", "UTC", "dmy", us(2012, 1, 6, 5, 32, 29)),
    ("2012-01-20 22:16:06 Europe/Athens", "UTC", "dmy", us(2012, 1, 20, 20, 16, 6)),
    ("1325811041", "Europe/Athens", "dmy", 1325811041 * 10**6),
    ("1325812699390", "UTC", "dmy", 1325812699390 * 1000),
    ("1328928469.386866", "UTC", "dmy", 1328928469386866),
    ("Jan 5, 2012 12:00:00 AM", "UTC", "dmy", us(2012, 1, 5)),
    ("Jan 32, 2012 1:00:00 AM", "UTC", "dmy", None),
    ("11 MARCH 2012 02:12:19", "UTC", "dmy", us(2012, 3, 11, 2, 12, 19)),
    ("2012/11/4 01:18:16.698am", "America/New_York", "dmy", us(2012, 11, 4, 5, 18, 16, 698000)),  # shown twice: the earlier
    ("2012-11-04 01:29:04 EST", "America/New_York", "dmy", us(2012, 11, 4, 6, 29, 4)),
    ("2012-03-11 02:30:00", "America/New_York", "dmy", None),  # never shown
    ("2012-04-01T01:45:00", "Australia/Lord_Howe", "dmy", us(2012, 3, 31, 14, 45)),  # half an hour is shown twice
    ("2012-01-07T24:00:00Z", "UTC", "dmy", us(2012, 1, 8)),
    ("2012-01-07T24:00:01Z", "UTC", "dmy", None),
    ("2012-01-05T25:01:00Z", "UTC", "dmy", None),
    ("2012-01-28 18:60:00", "UTC", "dmy", None),
    ("2012-01-10", "UTC", "dmy", None),
    ("17:18:39", "UTC", "dmy", None),
    ("\t\"2012-01-10 08:37:03.0\" ", "UTC", "dmy", us(2012, 1, 10, 8, 37, 3)),
    ("2012-01-10 08:37:03 JST", "UTC", "dmy", None),
    ("2012-01-10 08:37:03", None, "dmy", None),
    ("2012-01-10 08:37:03Z", None, None, us(2012, 1, 10, 8, 37, 3)),
    ("unknown", "UTC", "dmy", None),
    ("", "UTC", "dmy", None),
    (None, "UTC", "dmy", None),
    ("9" * 5000, "UTC", "dmy", None),
    ("２０１２-01-10 08:37:03", "UTC", "dmy", None),
]


def test_forms(spark):
    rows = [(i, t, z, o, "x") for i, (t, z, o, _) in enumerate(CASES)] * 2
    got = normalise(spark.createDataFrame(rows, "id long, text string, zone string, dates string, extra string"), ("id", "extra"), "text", "zone", "dates").collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert r["origin_us"] == CASES[r["id"]][3], (CASES[r["id"]], r)
        assert (r["status"] == 0) == (r["origin_us"] is not None)


def test_empty_and_clash(spark):
    empty = spark.createDataFrame([], "id long, text string, zone string, dates string")
    assert normalise(empty, ("id",), "text", "zone", "dates").count() == 0
    with pytest.raises(ValueError):
        normalise(empty.withColumnRenamed("id", "status"), ("status",), "text", "zone", "dates")


def test_random_local_times_agree_with_the_standard_library(spark):
    rng, rows, want = random.Random(2), [], {}
    for i in range(1500):
        z = rng.choice(ZONES)
        t = datetime(rng.randrange(2010, 2040), rng.choice([3, 4, 9, 10, 11, 6]), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), rng.randrange(60))
        early = t.replace(tzinfo=ZoneInfo(z), fold=0)
        shown = early.astimezone(timezone.utc).astimezone(ZoneInfo(z)).replace(tzinfo=None) == t
        want[i] = (early.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1) if shown else None
        rows.append((i, t.strftime(rng.choice(["%Y-%m-%d %H:%M:%S", "%Y%m%d%H%M%S", "%d %b %Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y-%jT%H:%M:%S"])), z, "mdy"))
    got = normalise(spark.createDataFrame(rows, "id long, text string, zone string, dates string"), ("id",), "text", "zone", "dates").collect()
    assert {r["id"]: r["origin_us"] for r in got} == want


def test_masks():
    assert layout_of(re.sub("[0-9]", "9", "12:30:00")) is None
    assert layout_of("a" * 40) is None
    assert len(zone_tables()) > 300


def test_many_digits_late_years_and_long_texts(spark):
    rows = [
        (1, "2020-01-01T00:00:00." + "0" * 70 + "Z", 1577836800000000), (2, "2020-01-01T00:00:00.123456" + "9" * 200 + "Z", 1577836800123456),
        (3, "2150-07-01 12:00:00", 5695977600000000), (4, "2150-01-15 12:00:00", 5681559600000000 + 86400000000 * 0), (5, "2020-01-01" + " " * 300 + "05:00:00", 1577872800000000),
        (6, "2020-01-01T24:00:00." + "0" * 30 + "1Z", None), (7, "x" * 100_000, None), (8, "2400-02-29 12:00:00", None),
    ]
    df = spark.createDataFrame([(i, t, "America/New_York", "mdy") for i, t, _ in rows], "id long, t string, z string, o string")
    got = {r["id"]: (r["origin_us"], r["status"]) for r in normalise(df, ("id",), "t", "z", "o").collect()}
    from datetime import datetime, timezone

    expected = dict((i, us) for i, _, us in rows)
    expected[4] = int(datetime(2150, 1, 15, 17, tzinfo=timezone.utc).timestamp()) * 10**6
    expected[8] = int(datetime(2400, 2, 29, 17, tzinfo=timezone.utc).timestamp()) * 10**6
    assert {i: us for i, (us, _) in got.items()} == expected
    assert got[7][1] == 1 and got[6][1] == 2


def test_late_years_follow_the_zone_everywhere():
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    for name in ("America/New_York", "Europe/Berlin", "Australia/Sydney", "Africa/Casablanca", "America/Santiago", "Asia/Tokyo", "Africa/Cairo"):
        zone, local, want = build_zone(name), [], []
        for y in (2099, 2128, 2129, 2150, 2199, 2200, 2300, 2400):
            for day in range(0, 365, 5):
                t = datetime(y, 1, 1, 12) + timedelta(days=day)
                local.append(round((t - datetime(1970, 1, 1)).total_seconds()) * 10**6)
                want.append(round((t.replace(tzinfo=ZoneInfo(name)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()) * 10**6)
        got, shown = zone.instants(np.array(local))
        assert shown.all() and got.tolist() == want, name


def test_only_the_named_version_of_the_zones_is_used(spark):
    df = spark.createDataFrame([], "id long, t string, z string, o string")
    assert normalise(df, ("id",), "t", "z", "o", version=zone_version()).collect() == []
    with pytest.raises(ValueError, match="version"):
        normalise(df, ("id",), "t", "z", "o", version="1900a")
