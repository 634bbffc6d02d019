"""Times kept as text, turned into epoch seconds independently of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?"
    r"(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?\z"
)
OFFSET = r"([+-])([0-9]{2}):?([0-9]{2})?\z"
EPOCH = r"\A-?[0-9]{1,18}\z"


def epoch_seconds(text: Column) -> Column:
    """ISO 8601 to the second (``T`` or space, fraction dropped; ``Z``, offset or
    nothing = UTC) or whole epoch seconds, as BIGINT; NULL for any other text."""
    part = lambda a, n: text.substr(a, n).try_cast("int")
    day = F.unix_date(text.substr(1, 10).try_cast("date")).cast("long")
    hour, minute, second = part(12, 2), part(15, 2), part(18, 2)
    zone = text.substr(F.lit(20), F.length(text))
    sign = F.when(F.regexp_extract(zone, OFFSET, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hours = F.coalesce(F.regexp_extract(zone, OFFSET, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(zone, OFFSET, 3).try_cast("int"), F.lit(0))
    iso = day * 86400 + hour * 3600 + minute * 60 + second - sign * (hours * 3600 + minutes * 60)
    fits = (hour < 24) & (minute < 60) & (second < 60)
    return F.when(text.rlike(ISO), F.when(fits, iso)).when(
        text.rlike(EPOCH), text.try_cast("long")
    )


def ntz_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone (read as UTC)."""
    return F.floor(ntz_micros(ts) / F.lit(1_000_000)).cast("long")


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (read as UTC)."""
    return F.timestamp_diff(
        "MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")
    )


def utc_month(seconds: Column) -> Column:
    """``yyyy-MM`` in UTC of epoch seconds, whatever the session zone."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM")
