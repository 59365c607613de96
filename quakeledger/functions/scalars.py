"""Row-level functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeledger.operators.spatial import distance_km

#: Mean radius of the earth that the audit's distances use.
AUDIT_RADIUS_KM = 6371.0088


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null where a coordinate is."""
    return distance_km(lat1, lon1, lat2, lon2, AUDIT_RADIUS_KM)


def leading_digit(x) -> Column:
    """First significant decimal digit of |x|; null for 0 and null."""
    x = F.abs(col(x))
    m = x / F.pow(F.lit(10.0), F.floor(F.log10(x)))
    m = F.when(m >= 10.0, m / 10.0).when(m < 1.0, m * 10.0).otherwise(m)
    return F.when(x > 0, F.floor(m).cast("int"))


def aftershock_radius_km(magnitude) -> Column:
    """Gardner and Knopoff's radius: 10 ** (0.1238 M + 0.983)."""
    return F.pow(F.lit(10.0), F.lit(0.1238) * col(magnitude) + F.lit(0.983))


def comparison_level(diff, scale: float, edges=(0.25, 0.6, 1.0)) -> Column:
    """How many of the edges (times scale) |diff| reaches; one more than all for a missing difference."""
    d = F.abs(col(diff))
    reached = sum((F.when(d >= e * scale, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(d.isNull(), F.lit(len(edges) + 1)).otherwise(reached)


def kernel_match_probability(diffs_and_scales: list[tuple]) -> Column:
    """Product of Gaussian kernels exp(-(d / s)^2 / 2); 0.5 for a missing difference."""
    out = F.lit(1.0)
    for d, s in diffs_and_scales:
        out = out * F.coalesce(F.exp(-0.5 * F.pow(col(d) / s, 2)), F.lit(0.5))
    return out


def wilson_interval(k, n, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a rate k / n; null for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = F.try_divide(k, n)
    centre = F.try_divide(p + z * z / (2 * n), 1 + z * z / n)
    half = F.try_divide(F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)), 1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def omori_integral(k, c, p, t1, t2) -> Column:
    """Expected events between t1 and t2 under K / (t + c) ** p."""
    k, c, p, t1, t2 = map(col, (k, c, p, t1, t2))
    near_one = F.abs(p - 1.0) < 1e-6
    power = k / (1.0 - p) * (F.pow(t2 + c, 1.0 - p) - F.pow(t1 + c, 1.0 - p))
    return F.when(near_one, k * (F.log(t2 + c) - F.log(t1 + c))).otherwise(power)


def recurrence_years(n, years, b, mc, magnitude: float = 6.0) -> Column:
    """Mean years between events of at least the magnitude, from the rate above mc."""
    a = F.log10(F.try_divide(col(n), col(years))) + col(b) * col(mc)
    return F.try_divide(F.lit(1.0), F.pow(F.lit(10.0), a - col(b) * magnitude))


def incompleteness_days(mainshock, mc) -> Column:
    """Days after a mainshock until events of magnitude mc are complete again: 10 ** ((M - 4.5 - mc) / 0.75)."""
    return F.pow(F.lit(10.0), (col(mainshock) - 4.5 - col(mc)) / 0.75)


def mechanism_of_rake(rake) -> Column:
    """Fault mechanism by rake: within 45 degrees of 90 reverse, of -90 normal, else strike-slip."""
    r = F.pmod(col(rake) + 180.0, F.lit(360.0)) - 180.0
    return F.when(r.isNull(), None).when((r >= 45) & (r <= 135), "reverse").when((r >= -135) & (r <= -45), "normal").otherwise("strike-slip")


# --- texts of raw files -----------------------------------------------------------------------------------------------


def number_or_null(c) -> Column:
    """A text as a number; blank, unreadable, NaN and infinite texts are null."""
    x = F.trim(col(c)).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_text(c) -> Column:
    """Without outer blanks and outer quotes."""
    return F.regexp_replace(F.trim(col(c)), "^['\"]+|['\"]+$", "")


def parse_depth(c) -> Column:
    """The first number in a text in km; texts with "mi" are miles."""
    t = F.lower(col(c))
    x = F.nullif(F.regexp_extract(t, r"([-+]?\d*\.?\d+)", 1), F.lit("")).try_cast("double")
    return F.when(F.contains(t, F.lit("mi")), x * 1.60934).otherwise(x)


def parse_magnitude(c) -> tuple[Column, Column]:
    """(magnitude, type) of texts like "5.6 Mw"."""
    pattern = r"^\s*([-+]?\d*\.?\d+)\s*([A-Za-z]*)"
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit("")).try_cast("double"), F.nullif(F.regexp_extract(col(c), pattern, 2), F.lit(""))


def parse_time(c) -> Column:
    """A timestamp in UTC of mixed forms; a missing separator between date and time is put in; unreadable is null."""
    t = F.regexp_replace(F.trim(col(c)), r"^(\d{4}-\d{2}-\d{2})(\d{2}:\d{2}.*)$", "$1T$2")
    t = F.regexp_replace(F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"), r"\s*(UTC|Z)$", "")
    slash = F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})(.*)$", "$3-$1-$2$4")
    return slash.try_cast("timestamp_ntz")


def signed_degrees(text) -> tuple[Column, Column]:
    """(latitude, longitude) of texts like "32.8 N 134.3 E", with or without degree signs."""
    pattern = r"([\d.]+)\s*°?\s*([NS])[\s,]*([\d.]+)\s*°?\s*([EW])"
    part = lambda i: F.nullif(F.regexp_extract(col(text), pattern, i), F.lit(""))
    lat, lon = part(1).try_cast("double"), part(3).try_cast("double")
    return F.when(part(2) == "S", -lat).otherwise(lat), F.when(part(4) == "W", -lon).otherwise(lon)


def merged_time(y, mo, d, h, mi, s) -> Column:
    """A timestamp of six columns; a missing second is 0, a missing hour or minute gives null."""
    y, mo, d, h, mi, s = (col(x).cast("int") for x in (y, mo, d, h, mi, s))
    return F.try_make_timestamp_ntz(y, mo, d, h, mi, F.coalesce(s, F.lit(0)).cast("double"))
