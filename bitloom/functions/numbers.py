"""Number, date and place encoders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH, BUCKETS = -1000.0, 1000.0, 100
WIDTH = (HIGH - LOW) / BUCKETS
#: First position of numbers; `compat` puts them where word bits lie.
NUMBER_START, COMPAT_START = 15000, 1000
GEO_STEPS = 1000
DATE_START = 2000


def number_bucket(v: Column) -> Column:
    """Right-closed bucket of a number, clamped to the range; null for NaN and infinities."""
    finite = ~(F.isnan(v) | v.isin(float("inf"), float("-inf")))
    at = F.ceil((F.least(F.greatest(v, F.lit(LOW)), F.lit(HIGH)) - LOW) / WIDTH) - 1
    return F.when(finite, F.greatest(F.lit(0), at).cast("long"))


def number_bits(v: Column, compat: bool = False) -> Column:
    """The positions of a number: one, or none for NaN and infinities."""
    at = number_bucket(v) + (COMPAT_START if compat else NUMBER_START)
    return F.filter(F.array(at), lambda x: x.isNotNull())


def bucket_middle(bucket: Column) -> Column:
    return LOW + WIDTH * bucket + WIDTH / 2


def number_text(positions: Column, start: int = NUMBER_START) -> Column:
    """Positions as text: the middle of each bucket, "?" for a position that is no number's."""
    bucket = lambda p: p - start
    middle = lambda p: bucket_middle(bucket(p)).cast("long").cast("string")
    return F.concat_ws(" ", F.transform(positions, lambda p: F.when((bucket(p) >= 0) & (bucket(p) < BUCKETS), middle(p)).otherwise("?")))


def range_text(low: Column, high: Column) -> Column:
    """The outer bounds of a range of buckets, as text."""
    bound = lambda b: (LOW + WIDTH * b).cast("long").cast("string")
    return F.concat(F.lit("["), bound(low), F.lit(", "), bound(high + 1), F.lit("]"))


def interpolate(bucket: Column, position: Column) -> Column:
    """A value inside a bucket; the position is clamped to [0, 1]."""
    return LOW + WIDTH * (bucket + F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0)))


def range_buckets(low: Column, high: Column, step: Column) -> Column:
    """Buckets of both ends, and of the step unless it is 1; null for an empty range or a step that is not positive."""
    ends = F.array(number_bucket(low), number_bucket(high))
    return F.when((low <= high) & (step > 0), F.when(step == 1, ends).otherwise(F.concat(ends, F.array(number_bucket(step)))))


def numbers_in(text: Column) -> Column:
    """Numbers among the words of a text: commas are dropped, other tokens skipped."""
    stripped = F.transform(F.split(text, r"[ \t\n\r]+"), lambda t: F.regexp_replace(t, ",", ""))
    return F.transform(F.filter(stripped, lambda t: t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")), lambda t: t.cast("double"))


def geo_bits(lat: Column, lon: Column) -> Column:
    """Cells of latitude and longitude, clamped."""
    cell = lambda v, m: F.floor((F.least(F.greatest(v, F.lit(-m)), F.lit(m)) + m) / (2 * m) * (GEO_STEPS - 1)).cast("long")
    return F.struct(cell(lat, 90.0).alias("lat_cell"), cell(lon, 180.0).alias("lon_cell"))


def geo_decode(cell: Column, most: float) -> Column:
    return cell / (GEO_STEPS - 1) * (2 * most) - most


def date_bits(ts: Column, offset_minutes: int = 0) -> Column:
    """Positions of a timestamp's year, month, day, hour, minute, second, fraction (if any) and offset."""
    base = lambda shift, c: (c + shift + DATE_START).cast("long")
    micros = F.expr("0") + (F.unix_micros(ts.cast("timestamp")) % 1_000_000)
    parts = F.array(base(-1900, F.year(ts)), base(199, F.month(ts)), base(299, F.day(ts)), base(400, F.hour(ts)), base(460, F.minute(ts)), base(520, F.second(ts)))
    fraction = F.when(micros > 0, F.array(base(580, micros))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(parts, fraction, F.array(F.lit(2500 + offset_minutes + 720).cast("long")))


def date_decode(bits: Column) -> Column:
    """The timestamp (whole seconds) of date_bits."""
    get = lambda i, shift: (F.element_at(bits, i) - shift - DATE_START).cast("int")
    return F.make_timestamp_ntz(get(1, -1900), get(2, 199), get(3, 299), get(4, 400), get(5, 460), get(6, 520).cast("double"))


def date_format(text: Column) -> Column:
    """iso8601, compact, relative, unix or unknown."""
    return (
        F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([+-][0-9]{2}:?[0-9]{2}|Z)?$"), "iso8601")
        .when(text.rlike(r"^[0-9]{14}(\.[0-9]+)?$"), "compact")
        .when(text.rlike(r"(?i)^(now|today|tomorrow|yesterday|last|next|this)[ ]*(day|week|month|year|hour|minute|second)s?[ ]*(ago)?$"), "relative")
        .when(text.rlike(r"^[0-9]+$"), "unix")
        .otherwise("unknown")
    )


#: Qualifiers and units of relative times, in the order of their positions.
QUALIFIERS = ("now", "last", "next", "this")
UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def relative_bits(qualifier: Column, unit: Column, ago: Column, start: int = 2750) -> Column:
    """Positions of a relative time: qualifier, unit, and direction if it lies in the past."""
    q = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, QUALIFIERS)), qualifier), F.lit(0)) - 1, F.lit(0))
    u = F.array_position(F.array(*map(F.lit, UNITS)), unit) - 1
    return F.concat(F.array(start + q, start + 10 + u), F.when(ago, F.array(F.lit(start + 20).cast("long"))).otherwise(F.array().cast("array<bigint>")))
