"""Event web services as a Spark data source: time windows planned by counts, each read by its own task.

spark.dataSource.register(EventService); spark.read.format("event_service").option("url", ...).option("start", ...) ...
Options: url, start, end (ISO times), min_magnitude, min_latitude, max_latitude, min_longitude, max_longitude (a box across
the antimeridian is cut in two), max_rows, format (geojson or quakeml), counts (how a service tells a window's events:
"endpoint", a count request; "total", a total in the answer's metadata that never exceeds max_rows; "none"), fetch
(module:function that takes a URL and gives text; by default the network with retries).

Nothing is lost in silence: a window that can't be read or is cut off by the service is halved, and one that can't be
halved any more is an error, as is the end of the requests a task may make.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "event_id string, origin_time timestamp, latitude double, longitude double, depth_km double, magnitude double, magnitude_type string"
MOST_DEPTH, LEAST_WINDOW_S, MOST_REQUESTS = 24, 60.0, 500
# Magnitude types that count as moment magnitudes.
MOMENT_TYPES = ("mw", "mww", "mwc", "mwb", "mwp", "mw(mwp)")


def fetch_with_retry(url: str, tries: int = 3, pause: float = 2.0, timeout: float = 15.0, get=None, sleep=time.sleep) -> str | None:
    """The text of a URL; None after three failures with growing pauses."""
    get = get or (lambda u: urllib.request.urlopen(u, timeout=timeout).read().decode("utf-8"))  # noqa: S310
    for i in range(tries):
        try:
            return get(url)
        except Exception:
            if i + 1 < tries:
                sleep(pause * (i + 1))
    return None


def boxes(low: float, high: float) -> list[tuple[float, float]]:
    """A longitude range in +-180 as one or two boxes; a range across the antimeridian (low above high, or beyond 180) is cut."""
    if high - low >= 360:
        return [(-180.0, 180.0)]
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    a, b = (low, high) if -180 <= low <= high <= 180 else (wrap(low), wrap(high))
    return [(a, b)] if a <= b else [(a, 180.0), (-180.0, b)]


@dataclass
class Window(InputPartition):
    """A box's time window; empty is the window of nothing."""

    start: str = ""
    end: str = ""
    box: tuple = ()

    def __init__(self, start: str = "", end: str = "", box: tuple = ()):
        super().__init__((start, end, box))
        self.start, self.end, self.box = start, end, box


class Incomplete(RuntimeError):
    """A service's answer can't be had whole."""


def halved(start: datetime, end: datetime, depth: int, why: str) -> datetime:
    """The middle of a window; an error where MOST_DEPTH or LEAST_WINDOW_S allows no further halving."""
    if depth >= MOST_DEPTH or (end - start).total_seconds() <= LEAST_WINDOW_S:
        raise Incomplete(f"{start} to {end}: {why}, and the window can't be divided any more")
    return start + (end - start) / 2


def _spend(budget: list[int]) -> None:
    budget[0] -= 1
    if budget[0] < 0:
        raise Incomplete(f"more than {MOST_REQUESTS} requests were needed; ask for less at a time")


def plan_windows(start: datetime, end: datetime, count, most: int, budget: list[int] | None = None, depth: int = 0) -> list[tuple[datetime, datetime]]:
    """Time windows with at most ``most`` events each, by halving; count(start, end) gives a window's events or None.

    A window that can't be counted is halved as well. MOST_REQUESTS counts may be asked for; see halved for the end.
    """
    budget = [MOST_REQUESTS] if budget is None else budget
    _spend(budget)
    n = count(start, end)
    if n is not None and n <= most:
        return [] if n == 0 else [(start, end)]
    mid = halved(start, end, depth, "the count failed" if n is None else f"{n} events")
    return plan_windows(start, mid, count, most, budget, depth + 1) + plan_windows(mid, end, count, most, budget, depth + 1)


def compact_box(lons: list[float], pad: float) -> tuple[float, float]:
    """The shortest longitude interval that holds all longitudes, padded; above 180 where it crosses the antimeridian."""
    x = sorted(v % 360.0 for v in lons)
    if not x:
        return (-180.0, 180.0)
    gaps = [(b - a, i) for i, (a, b) in enumerate(zip(x, [*x[1:], x[0] + 360.0]))]
    _, i = max(gaps)
    low, high = (x[0], x[-1]) if i == len(x) - 1 else (x[i + 1], x[i] + 360.0)
    low, high = low - pad, high + pad
    if high - low >= 360:
        return (-180.0, 180.0)
    turn = 360.0 if low >= 180 else 0.0
    return (low - turn, high - turn)


def parse_events(text: str) -> list[tuple]:
    """Rows of a GeoJSON answer; features without a time or place are left out."""
    out = []
    for f in json.loads(text).get("features", []):
        p, xyz = f.get("properties") or {}, (f.get("geometry") or {}).get("coordinates") or []
        when = p.get("time")
        if len(xyz) < 2 and "lon" in p and "lat" in p:  # some services repeat the place among the properties only
            xyz = [p["lon"], p["lat"], p.get("depth")]
        if when is None or len(xyz) < 2:
            continue
        at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=when) if isinstance(when, (int, float)) else datetime.fromisoformat(str(when).replace("Z", "+00:00"))
        number = lambda x: None if x is None else float(x)
        out.append((f.get("id"), at, number(xyz[1]), number(xyz[0]), number(xyz[2]) if len(xyz) > 2 else None, number(p.get("mag")), p.get("magType") or p.get("magtype")))
    return out


def parse_quakeml(text: str) -> list[tuple]:
    """Rows of a QuakeML answer: preferred origin or the first; preferred magnitude, the first moment magnitude or the largest."""
    local = lambda e: e.tag.rpartition("}")[2]
    kids = lambda e, name: [k for k in e if local(k) == name]

    def value(e, name: str) -> str | None:
        return next((v.text for k in kids(e, name) for v in kids(k, "value")), None)

    def preferred(e, name: str, ref: str):
        ids = [k.text for k in kids(e, ref)]
        return next((k for k in kids(e, name) if ids and k.get("publicID") == ids[0]), None)

    out = []
    try:
        events = [e for e in ElementTree.fromstring(text).iter() if local(e) == "event"]
    except ElementTree.ParseError:
        return []
    for e in events:
        try:
            o = preferred(e, "origin", "preferredOriginID")
            o = o if o is not None else kids(e, "origin")[0]
            mags = [(float(value(m, "mag")), next((t.text for t in kids(m, "type")), None), m) for m in kids(e, "magnitude") if value(m, "mag")]
            chosen = preferred(e, "magnitude", "preferredMagnitudeID")
            m = next((x for x in mags if x[2] is chosen), None) or next((x for x in mags if (x[1] or "").lower() in MOMENT_TYPES), None) or max(mags, key=lambda x: x[0], default=(None, None, None))
            at = datetime.fromisoformat(value(o, "time").replace("Z", "+00:00"))
            depth = value(o, "depth")
            out.append((e.get("publicID"), at if at.tzinfo else at.replace(tzinfo=timezone.utc), float(value(o, "latitude")), float(value(o, "longitude")), None if depth is None else float(depth) / 1000, m[0], m[1]))
        except (IndexError, TypeError, ValueError, AttributeError):
            continue  # an event without an origin or with an unreadable one
    return out


class EventService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EventReader(dict(self.options))


class EventReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}

    def _get(self, url: str) -> str | None:
        get = None
        if named := self.o.get("fetch"):
            module, _, function = named.partition(":")
            get = getattr(importlib.import_module(module), function)
        return fetch_with_retry(url, get=get, pause=float(self.o.get("pause", 2.0)))

    def _url(self, what: str, start: datetime, end: datetime, box: tuple[float, float], limit: int | None = None) -> str:
        form = "xml" if self.o.get("format") == "quakeml" else "json" if self._counts() == "total" else "geojson"
        q = {"format": form, "starttime": start.isoformat(), "endtime": end.isoformat(), "minlongitude": box[0], "maxlongitude": box[1]}
        names = {"min_magnitude": "minmagnitude", "min_latitude": "minlatitude", "max_latitude": "maxlatitude"}
        q |= {v: self.o[k] for k, v in names.items() if k in self.o} | ({"limit": limit} if limit else {})
        return f"{self.o['url'].rstrip('/')}/{what}?{urllib.parse.urlencode(q)}"

    def _counts(self) -> str:
        return self.o.get("counts", "endpoint")

    def _most(self) -> int:
        return int(self.o.get("max_rows", 20_000))

    def _count(self, start: datetime, end: datetime, box: tuple[float, float]) -> int | None:
        """A window's events, None if the request failed; a total that reaches the cap may be any number above it."""
        total = self._counts() == "total"
        text = self._get(self._url("query", start, end, box, 1) if total else self._url("count", start, end, box))
        if total and text is not None and not text.strip():
            return 0  # no content stands for no events
        try:
            if text is None:
                return None
            n = int(json.loads(text)["metadata"]["totalCount"] if total else json.loads(text)["count"] if text.lstrip().startswith("{") else text)
            return self._most() + 1 if total and n >= self._most() else n
        except (ValueError, KeyError, TypeError):
            return None

    def _boxes(self) -> list[tuple[float, float]]:
        return boxes(float(self.o.get("min_longitude", -180)), float(self.o.get("max_longitude", 180)))

    def partitions(self) -> list[Window]:
        start, end = (datetime.fromisoformat(self.o[k]) for k in ("start", "end"))
        out, budget = [], [MOST_REQUESTS]  # shared by both boxes
        for box in self._boxes():
            if self._counts() == "none":  # a window a month; what is too full is halved where it is read
                n = max(1, min(MOST_REQUESTS, (end - start).days // 30))
                cuts = [start + (end - start) * i / n for i in range(n + 1)]
                found = list(zip(cuts, cuts[1:]))
            else:
                found = plan_windows(start, end, lambda a, b, box=box: self._count(a, b, box), self._most(), budget)
            out += [Window(a.isoformat(), b.isoformat(), box) for a, b in found]
        return out or [Window()]

    def read(self, partition: Window):
        if partition.start:
            yield from self._rows(*map(datetime.fromisoformat, (partition.start, partition.end)), partition.box, [MOST_REQUESTS])

    def _rows(self, start: datetime, end: datetime, box: tuple, budget: list[int], depth: int = 0):
        """A window's rows; a window that fails or comes with as many events as the service gives at most is halved."""
        _spend(budget)
        text = self._get(self._url("query", start, end, box))
        rows = None
        if text is not None:
            try:
                rows = [] if not text.strip() else (parse_quakeml if self.o.get("format") == "quakeml" else parse_events)(text)
            except ValueError:
                rows = None
        if rows is not None and (len(rows) < self._most() or (self._counts() == "endpoint" and len(rows) == self._most())):
            yield from rows
            return
        mid = halved(start, end, depth, "the request failed" if rows is None else f"{len(rows)} events")
        yield from self._rows(start, mid, box, budget, depth + 1)
        yield from self._rows(mid, end, box, budget, depth + 1)

    def is_feasible(self) -> bool:
        """Whether the service answers a small probe; a source that doesn't is left out of an audit."""
        end = datetime.fromisoformat(self.o["end"])
        what = "query" if self._counts() == "none" else None
        probe = end - timedelta(days=1), end, self._boxes()[0]
        return (self._get(self._url(what, *probe)) if what else self._count(*probe)) is not None


def feasible_references(spark, services: dict[str, dict]):
    """The union of the services that answer a probe, with source_id; no service gives an empty table of the same columns.

    services: source_id to the options of EventService. A service is probed once, on the driver, before anything is planned.
    """
    from pyspark.sql import functions as F

    spark.dataSource.register(EventService)
    out = spark.createDataFrame([], f"source_id string, {SCHEMA}")
    for name, options in sorted(services.items()):
        if EventReader(options).is_feasible():
            out = out.unionByName(spark.read.format("event_service").options(**options).load().select(F.lit(name).alias("source_id"), "*"))
    return out
