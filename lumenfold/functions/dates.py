"""Date expressions over ISO-8601 strings; everything is a Column, nothing raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DASHED_DATE, DAY_DATE, FILENAME_DATES, MAX_YEAR, MIN_YEAR, YEAR_ALONE

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$"


def to_ts(text: Column) -> Column:
    """Timestamp of the first 19 characters, null where they are no ISO date (a bare year or month is none)."""
    head = F.substring(text, 1, 19)
    return F.when(head.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(head, "T", " "))).cast("timestamp_ntz")


def in_years(ts: Column) -> Column:
    middle, half = (MIN_YEAR + MAX_YEAR) / 2, (MAX_YEAR - MIN_YEAR) / 2
    return F.abs(F.year(ts) - middle) <= half  # the timestamp stands once, so it is parsed once


def is_bad(text: Column) -> Column:
    """Missing, unparsable or outside the years."""
    return bad(to_ts(text))


def bad(ts: Column) -> Column:
    """The same of a timestamp, for callers that parse a text once and test it several times."""
    return ~F.coalesce(in_years(ts), F.lit(False))


def default(ts: Column) -> Column:
    first = (F.month(ts) == 1) & (F.dayofmonth(ts) == 1)
    return bad(ts) | (first & midnight(ts))


def low_confidence(ts: Column) -> Column:
    return bad(ts) | midnight(ts)


def midnight(ts: Column) -> Column:
    return ts == F.date_trunc("day", ts).cast("timestamp_ntz")


def is_default(text: Column) -> Column:
    """Bad, or the first of January at midnight, as cameras without a clock write it."""
    return default(to_ts(text))


def is_low_confidence(text: Column) -> Column:
    """Default, or exactly midnight."""
    return low_confidence(to_ts(text))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods between two timestamps, rounded down (not calendar boundaries)."""
    seconds = lambda t: F.unix_seconds(t.cast("timestamp"))
    return F.floor((seconds(later) - seconds(earlier)) / 86400)


def from_epoch(text: Column) -> Column:
    """ISO UTC string of positive epoch seconds given as text."""
    seconds = text.try_cast("bigint")
    return F.when(seconds > 0, F.concat(iso(F.timestamp_seconds(seconds)), F.lit("+00:00")))


def _calendar(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def from_filename(name: Column) -> Column:
    """The first of five patterns whose first match is a valid date within the years."""
    dates = []
    for pattern in FILENAME_DATES:
        part = lambda k, p=pattern: F.regexp_extract(name, p, k)
        ts = F.when(part(1) != "", _calendar(part(1), part(2), part(3)))
        dates.append(F.when(in_years(ts), ts))
    return F.when(name.rlike(r"\d{4}"), iso(F.coalesce(*dates)))


def from_directory(path: Column) -> Column:
    """`15 Jun 2019`, else `2019-06-15`, else a bare year as its middle (June 15)."""
    base = F.substring_index(path, "/", -1)
    part = lambda k: F.regexp_extract(base, DAY_DATE, k)
    named = F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), part(3)), F.lit("d MMM yyyy")).cast("timestamp_ntz")
    dash = _calendar(*(F.regexp_extract(base, DASHED_DATE, k) for k in (1, 2, 3)))
    year = F.regexp_extract(base, YEAR_ALONE, 1)
    middle = F.when(year != "", _calendar(year, F.lit("06"), F.lit("15")))
    return iso(F.coalesce(*(F.when(in_years(t), t) for t in (F.when(part(1) != "", named), F.when(F.regexp_extract(base, DASHED_DATE, 1) != "", dash), middle))))


def from_exif(text: Column) -> Column:
    """`YYYY:MM:DD HH:MM:SS`, zero dates rejected."""
    ts = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    return F.when(in_years(ts), iso(ts))


def from_modified(modified: Column) -> Column:
    """ISO UTC string of a file's modification time (a timestamp), within the years."""
    return F.when(in_years(modified), F.concat(iso(modified), F.lit("+00:00")))


def lenient(text: Column) -> Column:
    """ISO with a blank or `T`, or an EXIF date, as a timestamp."""
    head = F.substring(text, 1, 19)
    return F.coalesce(*(F.try_to_timestamp(head, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss"))).cast("timestamp_ntz")


def cascade(*methods: tuple[str, Column]) -> Column:
    """The first acceptable date of (method, date) pairs in order, as a struct of taken and method, or null.

    The pairs are an array, so each date stands in the plan once and the test of it once for all.
    """
    pairs = F.array(*(F.struct(date.alias("taken"), F.lit(name).alias("method")) for name, date in methods))
    return F.get(F.filter(pairs, lambda x: ~is_bad(x["taken"])), 0)


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "autumn")


def trip_length(days: Column) -> Column:
    n = lambda c: c.cast("bigint").cast("string")
    return (
        F.when(days == 1, "2-day trip").when(days < 7, F.concat(n(days + 1), F.lit("-day trip")))
        .when(days < 14, F.concat(n(F.floor((days + 6) / 7)), F.lit("-week trip"))).otherwise(F.concat(n(days), F.lit(" days")))
    )


def year_or_undated(text: Column) -> Column:
    return F.coalesce(F.date_format(to_ts(text), "yyyy"), F.lit("Undated"))


def repaired_directory(name: Column) -> Column:
    """`2019:06:15` as `15 Jun 2019`; any other colon becomes a dash."""
    ts = F.try_to_timestamp(F.when(name.rlike(r"^\d{4}:\d{2}:\d{2}$"), name), F.lit("yyyy:MM:dd"))
    return F.coalesce(F.date_format(ts, "dd MMM yyyy"), F.replace(name, F.lit(":"), F.lit("-")))
