"""Timestamps of many written forms and zones, brought to microseconds since 1970-01-01 UTC.

Every text is reduced to a shape mask (digits to 9, letters to a). All texts of a mask have their parts at the same
places, so each distinct mask is mapped to a layout once per worker, and the digits of all its rows are read together
from a matrix of bytes. Clock times become instants through transition tables that the driver builds from one version
of the zone database and sends to all executors.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = 1_000_000
DAY_US = 86_400 * US
#: Tables reach this year. Beyond it a zone follows the rule at the end of its file, which gives two years that begin on
#: the same weekday and are of one length the same clock; CYCLE holds years of all kinds, in which only the rules hold.
LAST_YEAR, CYCLE = 2140, range(2101, 2129)
FAR = 2**62

# --- zone transition tables -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Zone:
    """Period i runs from starts[i] (UTC, microseconds) to the next start, with offsets[i] (microseconds) and names[i]."""

    starts: np.ndarray
    offsets: np.ndarray
    names: tuple[str, ...]

    def _periods(self, local: np.ndarray) -> np.ndarray:
        """The first period that could hold each clock time; it and the next three are enough."""
        return np.maximum(np.searchsorted(self.starts, local - 36 * 3600 * US, side="right") - 1, 0)

    def instants(self, local: np.ndarray, name: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(UTC, shown) of clock times: the earlier where shown twice; with a name, only periods of that abbreviation."""
        shift = _to_cycle(local)
        local = local - shift
        out, found = np.zeros(len(local), np.int64), np.zeros(len(local), bool)
        allowed = np.array([name is None or n == name for n in self.names])
        ends = np.append(self.starts[1:], FAR)
        first = self._periods(local)
        for k in range(4):
            i = np.minimum(first + k, len(self.starts) - 1)
            t = local - self.offsets[i]
            hit = ~found & allowed[i] & (t >= self.starts[i]) & (t < ends[i])
            out[hit], found[hit] = t[hit], True
        return out + shift * found, found


def _to_cycle(local: np.ndarray) -> np.ndarray:
    """Microseconds by which clock times after CYCLE are moved back to its year of the same kind; 0 for all others."""
    year = local.astype("datetime64[us]").astype("datetime64[Y]").astype(np.int64) + 1970
    late = year >= CYCLE.stop
    if not late.any():
        return np.zeros(len(local), np.int64)

    def start(y: np.ndarray) -> np.ndarray:
        return (y - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)

    def kind(y: np.ndarray) -> np.ndarray:
        return start(y) % 7 * 2 + (start(y + 1) - start(y) - 365)

    same = np.zeros(14, np.int64)
    years = np.array(CYCLE)
    same[kind(years)] = years
    return np.where(late, (start(year) - start(same[kind(year)])) * DAY_US, 0)


def _zone_bytes(name: str) -> bytes | None:
    import zoneinfo

    for root in zoneinfo.TZPATH:
        if (path := Path(root, name)).is_file():
            return path.read_bytes()
    try:
        from importlib import resources

        return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
    except (ModuleNotFoundError, FileNotFoundError):
        return None


def _transition_times(data: bytes) -> list[int]:
    """The explicit transition seconds of a compiled zone file (RFC 8536; the 64-bit block where there is one)."""
    head = struct.Struct(">4sc15x6l")
    magic, version, isut, isstd, leap, times, types, chars = head.unpack_from(data)
    if magic != b"TZif":
        return []
    at, width = head.size, 4
    if version >= b"2":
        at += times * 5 + types * 6 + chars + leap * 8 + isstd + isut
        _, _, isut, isstd, leap, times, types, chars = head.unpack_from(data, at)
        at, width = at + head.size, 8
    return list(struct.unpack_from(f">{times}{'q' if width == 8 else 'l'}", data, at))


_RULE = re.compile(r"(?:<[^>]+>|[A-Za-z]+)(?P<std>[-+0-9:]+)(?:<[^>]+>|[A-Za-z]+)(?P<dst>[-+0-9:]+)?,(?P<on>[^,/]+)(?:/(?P<on_at>[^,]+))?,(?P<off>[^,/]+)(?:/(?P<off_at>.+))?")


def _clock_seconds(text: str) -> int:
    """[+-]h[:mm[:ss]] in seconds."""
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return (-1 if text.startswith("-") else 1) * sum(x * u for x, u in zip(parts, (3600, 60, 1)))


def rule_cuts(footer: str) -> list[int]:
    """The seconds since 1970 at which a rule (std offset dst[offset],start[/time],end[/time]) changes a zone's clock, 1970 to LAST_YEAR.

    Days are Mm.w.d (the w-th weekday d of month m, 5 the last), Jn (1 to 365, no 29 February) or n (0 to 365). A footer
    without a rule gives none.
    """
    m = _RULE.fullmatch(footer)
    if not m:
        return []
    std = _clock_seconds(m["std"])
    dst = _clock_seconds(m["dst"]) if m["dst"] else std - 3600
    years = np.arange(1970, LAST_YEAR + 1)

    def days(rule: str) -> np.ndarray:
        if rule[0] == "M":
            month, week, weekday = (int(x) for x in rule[1:].split("."))
            first = _month_starts(years, np.full(len(years), month))
            day = first + (weekday - (first + 4)) % 7 + 7 * (week - 1)  # 1970-01-01 was a Thursday
            return np.where(day >= _month_starts(years, np.full(len(years), month + 1)), day - 7, day)
        first = _month_starts(years, np.ones(len(years), np.int64))
        if rule[0] == "J":
            n = int(rule[1:])
            leap = _month_starts(years + 1, np.ones(len(years), np.int64)) - first == 366
            return first + n - 1 + (leap & (n >= 60))
        return first + int(rule)

    on = days(m["on"]) * 86_400 + _clock_seconds(m["on_at"] or "2") + std
    off = days(m["off"]) * 86_400 + _clock_seconds(m["off_at"] or "2") + dst
    return sorted(on.tolist() + off.tolist())


@lru_cache(maxsize=None)
def build_zone(name: str) -> Zone | None:
    """A zone's periods up to LAST_YEAR; None for an unknown name."""
    from zoneinfo import ZoneInfo

    data = _zone_bytes(name)
    if data is None or data[:4] != b"TZif":
        return None
    zone, epoch = ZoneInfo(name), datetime(1970, 1, 1, tzinfo=timezone.utc)
    state = lambda s: ((t := (epoch + timedelta(seconds=s)).astimezone(zone)).utcoffset(), t.tzname())
    low, high = -int(1.9e9 * 32), int((datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    low = int((datetime(1, 1, 3, tzinfo=timezone.utc) - epoch).total_seconds())
    cuts = [s for s in _transition_times(data) if low < s < high]
    footer = data.rstrip(b"\n").rpartition(b"\n")[2].decode("ascii", "replace")
    cuts += [s for s in rule_cuts(footer) if (cuts[-1] if cuts else 0) < s < high]
    starts, offsets, names = [-FAR], [], []
    offset, label = state(low)
    offsets.append(offset // timedelta(microseconds=1))
    names.append(label)
    for s in sorted(set(cuts)):
        offset, label = state(s)
        offset = offset // timedelta(microseconds=1)
        if (offset, label) != (offsets[-1], names[-1]):
            starts.append(s * US)
            offsets.append(offset)
            names.append(label)
    return Zone(np.array(starts, np.int64), np.array(offsets, np.int64), tuple(names))


def zone_version() -> str:
    """The version of the zone database the tables come from."""
    import zoneinfo

    for root in zoneinfo.TZPATH:
        for file, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            if (path := Path(root, file)).is_file() and (m := re.match(pattern, path.read_text(errors="replace"))):
                return m[1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def zone_tables() -> dict[str, Zone]:
    """All zones of the database: about 600, a few MB, whatever the data's size."""
    import zoneinfo

    return {name: z for name in sorted(zoneinfo.available_timezones()) if (z := build_zone(name))}


# --- masks and layouts ------------------------------------------------------------------------------------------------

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_OF = {**{m: i for i, m in enumerate(MONTHS, 1)}, **{m[:3]: i for i, m in enumerate(MONTHS, 1)}, "sept": 9}


def shape_mask(text: Column) -> Column:
    """Digits to 9 and letters to a; all else stays."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "a")


def trimmed(text: Column) -> Column:
    """Without outer blanks, one pair of outer quotes, and blanks inside those."""
    t = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    return F.regexp_replace(t, r"""\A(["'])\s*(.*?)\s*\1\z""", "$2")


LONGEST = 200


def folded(text: Column) -> Column:
    """Fractions of more than 18 digits cut to 18, the last one saying whether anything is left; runs of blanks to two."""
    t = F.regexp_replace(text, r"(?<f>[.,][0-9]{17})[0-9]*[1-9][0-9]*", "${f}1")
    t = F.regexp_replace(t, r"([.,][0-9]{17})0{2,}(?![0-9])", "$10")
    return F.regexp_replace(t, " {3,}", "  ")


_DATES = (
    ("ymd", r"(?P<y>9999)-(?P<m>99)-(?P<d>99)", r"a| +|_|"),
    ("ymd", r"(?P<y>9999)/(?P<m>99?)/(?P<d>99?)", r"a| +|_"),
    ("ordinal", r"(?P<y>9999)[- ](?P<o>999)", r"a| +|_"),
    ("numeric", r"(?P<p>99?)(?P<s>[/.-])(?P<q>99?)(?P=s)(?P<y>9999)", r"a| +|_"),
    ("named", r"(?P<d>99?)[ -](?P<b>a{3,9})\.?[ -](?P<y>9999)", r"a| +|_"),
    ("named", r"(?P<b>a{3,9})\.? (?P<d>99?),? (?P<y>9999)", r"a| +|_"),
)
_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<h>aa)(?![a9/_]))?"
_WHERE = r"(?: *(?P<off>[+-]99(?::?99)?)(?:\[(?P<in>[^\]]+)\])?| *\[(?P<in2>[^\]]+)\]| ?(?P<z>a[a9/_+-]*))?"
_FORMS = [(kind, re.compile(rf"{date}(?P<sep>{sep}){_CLOCK}{_WHERE}")) for kind, date, sep in _DATES]
_FORMS.append(("ymd", re.compile(rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?P<sep>a?)(?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9+))?(?P<h>)?{_WHERE}")))
#: Digits of a count since 1970, by the unit's size in nanoseconds.
_EPOCH = ((re.compile(r"(?P<n>9{9,10})(?:\.(?P<f>9+))?"), 10**9), (re.compile("(?P<n>9{12,13})"), 10**6), (re.compile("(?P<n>9{15,16})"), 10**3), (re.compile("(?P<n>9{18,19})"), 1))


@dataclass(frozen=True)
class Layout:
    """Where the parts of a mask stand: part name to (from, to)."""

    kind: str
    parts: dict
    unit: int = 0


def layout_of(mask: str) -> Layout | None:
    """The parser of a mask; None for a shape that names no instant (a date or time alone, words, other scripts)."""
    for form, unit in _EPOCH:
        if m := form.fullmatch(mask):
            return Layout("epoch", {k: m.span(k) for k in m.groupdict() if m.start(k) >= 0}, unit)
    for kind, form in _FORMS:
        if m := form.fullmatch(mask):
            return Layout(kind, {k: m.span(k) for k in m.groupdict() if m.start(k) >= 0})
    return None


def _number(a: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    if span is None or span[1] <= span[0]:
        return np.zeros(len(a), np.int64)
    digits = a[:, span[0] : span[1]].astype(np.int64) - 48
    return digits @ (10 ** np.arange(span[1] - span[0] - 1, -1, -1, dtype=np.int64))


def _words(a: np.ndarray, span: tuple[int, int]) -> tuple[list[str], np.ndarray]:
    """The distinct texts of a part, and each row's number among them."""
    part = np.ascontiguousarray(a[:, span[0] : span[1]]).view(f"S{span[1] - span[0]}")[:, 0]
    words, at = np.unique(part, return_inverse=True)
    return [w.decode("ascii") for w in words], at


def _month_starts(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Days since 1970 of the first of a month; m may be 13."""
    return ((y - 1970) * 12 + m - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)


def read_rows(layout: Layout, a: np.ndarray, zones: np.ndarray, orders: np.ndarray, tables: dict[str, Zone]) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970 UTC, status) of rows of one mask. a: their bytes; status 0 stands for an instant."""
    n, at = len(a), layout.parts
    status = np.zeros(n, np.int8)
    f = at.get("f")
    micro = _number(a, (f[0], min(f[1], f[0] + 6))) * 10 ** max(0, 6 - (f[1] - f[0])) if f else np.zeros(n, np.int64)
    if layout.kind == "epoch":
        if at["n"][1] - at["n"][0] == 19:
            head, tail = _number(a, (at["n"][0], at["n"][0] + 16)), 0
            return head, status
        value = _number(a, at["n"])
        return (value * (layout.unit // 1000) + micro if layout.unit >= 1000 else value // 1000), status
    bad = np.zeros(n, bool)
    y = _number(a, at["y"])
    if layout.kind == "ordinal":
        day = _number(a, at["o"])
        first, after = _month_starts(y, np.ones(n, np.int64)), _month_starts(y + 1, np.ones(n, np.int64))
        bad |= (day < 1) | (day > after - first)
        days = first + day - 1
    else:
        if layout.kind == "numeric":
            p, q = _number(a, at["p"]), _number(a, at["q"])
            dmy, mdy = orders == "dmy", orders == "mdy"
            bad |= ~(dmy | mdy)
            d, m = np.where(dmy, p, q), np.where(dmy, q, p)
        elif layout.kind == "named":
            words, which = _words(a, at["b"])
            d, m = _number(a, at["d"]), np.array([MONTH_OF.get(w.lower(), 0) for w in words], np.int64)[which]
        else:
            d, m = _number(a, at["d"]), _number(a, at["m"])
        bad |= (m < 1) | (m > 12)
        safe = np.clip(m, 1, 12)
        first, after = _month_starts(y, safe), _month_starts(y, safe + 1)
        bad |= (d < 1) | (d > after - first)
        days = first + d - 1
    bad |= y < 1
    if at.get("sep", (0, 0))[1] - at.get("sep", (0, 0))[0] == 1:
        sep = a[:, at["sep"][0]]
        bad |= ~np.isin(sep, np.frombuffer(b"Tt _", np.uint8))
    H, M, S = (_number(a, at.get(k)) for k in "HMS")
    if "h" in at and at["h"][1] > at["h"][0]:
        words, which = _words(a, at["h"])
        half = np.array([{"am": 0, "pm": 12}.get(w.lower(), -1) for w in words], np.int64)[which]
        bad |= (half < 0) | (H < 1) | (H > 12)
        H = H % 12 + half
    end_of_day = (H == 24) & (M == 0) & (S == 0) & (_number(a, f) == 0)
    bad |= ((H > 23) & ~end_of_day) | (M > 59) | (S > 59)
    local = days * DAY_US + ((H * 60 + M) * 60 + S) * US + micro
    out = np.zeros(n, np.int64)
    status[bad] = 2
    if "off" in at:
        s, e = at["off"]
        hours = _number(a, (s + 1, s + 3))
        minutes = _number(a, (e - 2, e)) if e - s > 3 else np.zeros(n, np.int64)
        sign = np.where(a[:, s] == ord("-"), -1, 1)
        out = local - sign * (hours * 60 + minutes) * 60 * US
        status[~bad & ((hours > 18) | (minutes > 59))] = 3
        return out, status
    token = at.get("z") or at.get("in2")
    if token:
        words, which = _words(a, token)
    else:
        words, which = [""], np.zeros(n, int)
    homes, home = np.unique(zones, return_inverse=True)
    for w, word in enumerate(words):
        for h, zone_name in enumerate(homes):
            rows = np.nonzero((which == w) & (home == h) & ~bad)[0]
            if not len(rows):
                continue
            if word.upper() in ("Z", "UTC", "GMT"):
                out[rows] = local[rows]
                continue
            named = word and ("/" in word or "in2" in at)
            zone = tables.get(word if named else zone_name)
            if zone is None or (word and not named and word.upper() not in zone.names):
                status[rows] = 3
                continue
            abbreviation = word.upper() if word and not named else None
            t, shown = zone.instants(local[rows], abbreviation)
            if abbreviation and not shown.all():  # an abbreviation out of its season still names its offset
                offset = zone.offsets[max(i for i, x in enumerate(zone.names) if x == abbreviation)]
                _, clock = zone.instants(local[rows])
                late = ~shown & clock
                t, shown = np.where(late, local[rows] - offset, t), shown | late
            out[rows] = t
            status[rows[~shown]] = 4
    return out, status


#: What the statuses of normalise() stand for.
STATUS = {0: "instant", 1: "no instant in this shape", 2: "no such date or time", 3: "unknown zone", 4: "never shown by its zone"}


def normalise(
    rows: DataFrame, keep: tuple[str, ...], text: str, zone: str, date_order: str, tables: dict[str, Zone] | None = None, version: str | None = None
) -> DataFrame:
    """keep + (mask, origin_us, status): each text's instant in microseconds since 1970 UTC, or why there is none.

    A zone, offset or abbreviation in the text decides, else the row's zone; a clock time shown twice is the earlier
    one; one that its zone never shows is refused (4). Null and blank texts are shapes without an
    instant (1). A null or unknown zone refuses only the texts that need it (3); a null date order only dates in
    numbers with the year last (2). Digits finer than microseconds are cut off. One narrow pass, no shuffle.
    """
    if clash := {"mask", "origin_us", "status"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are named twice")
    if version is not None and version != (at_hand := zone_version()):
        raise ValueError(f"the zone database is of version {at_hand}, not {version}")
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(zone_tables() if tables is None else tables)
    layouts: dict[str, Layout | None] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, status = np.zeros(len(b), np.int64), np.ones(len(b), np.int8)
            texts, zones, orders = (b[c].fillna("").to_numpy(object) for c in ("__text", "__zone", "__order"))
            for mask, at in b.groupby("mask", dropna=True).indices.items():
                if mask not in layouts:
                    if len(layouts) > 100_000:
                        layouts.clear()
                    layouts[mask] = layout_of(mask)
                if (layout := layouts[mask]) is None:
                    continue
                a = texts[at].astype(f"S{len(mask)}").view(np.uint8).reshape(len(at), len(mask))
                us[at], status[at] = read_rows(layout, a, zones[at].astype(str), orders[at].astype(str), known.value)
            out = b[list(keep) + ["mask"]].copy()
            out["origin_us"] = pd.array(us, dtype="Int64").astype("Int64")
            out.loc[status != 0, "origin_us"] = pd.NA
            out["status"] = status.astype(np.int32)
            yield out

    # Once folded no instant is longer than its date, clock, 19 digits and the longest zone's name; what is has no mask.
    clean = folded(trimmed(F.col(text)))
    short = F.when(F.length(clean) <= LONGEST, clean)
    got = rows.select(*keep, short.alias("__text"), F.col(zone).alias("__zone"), F.col(date_order).alias("__order")).withColumn("mask", shape_mask(F.col("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.select(*keep).schema) + ", mask string, origin_us long, status int"
    return got.mapInPandas(run, schema)
