"""Day and zone functions on columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_iso_day(text: Column) -> Column:
    """Shape and calendar."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def add_days(day: Column, n: Column | int) -> Column:
    return F.date_add(day, n)


def days_between(a: Column, b: Column) -> Column:
    """Both ends counted."""
    return F.datediff(b, a) + 1


def day_in_zone(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def day_range_to_utc(first: Column, last: Column, zone: str) -> tuple[Column, Column]:
    """The instants of [first 00:00, day after last 00:00) in a zone. Where a zone skips midnight, the
    day starts at the instant of the jump."""
    return F.to_utc_timestamp(first.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(last, 1).cast("timestamp"), zone)


def latest_capture(now: Column) -> Column:
    """Today's noon in UTC, or yesterday's before it."""
    noon = F.date_trunc("day", now) + F.expr("INTERVAL 12 HOURS")
    return F.when(now >= noon, noon).otherwise(noon - F.expr("INTERVAL 1 DAY"))


def history_days(pairs: Column) -> Column:
    """A year, or more if that makes too few points."""
    return F.greatest(F.lit(365).cast("long"), F.ceil(F.lit(50_000) / pairs))


def retry_delay(attempt: Column) -> Column:
    """Seconds: 60, 240, 960 ..."""
    return (F.lit(60) * F.pow(F.lit(4.0), attempt - 1)).cast("long")


def today_in_zone(now: Column, zone: str) -> Column:
    """The calendar day that it is in a zone at an instant."""
    return day_in_zone(now, zone)


#: Fixed value, as a pattern: an ISO 8601 date, with a time of day or without, with a zone or without.
_ISO = "(?i)^(\\d{4})-(\\d{2})-(\\d{2})(?:T(\\d{2}):(\\d{2})(?::(\\d{2})(?:[.,](\\d+))?)?(Z|([+-])(\\d{2})(?::?(\\d{2}))?)?)?$"


def read_iso_date(text: Column) -> Column:
    """struct(epoch_ms, has_time, has_zone) of a strict ISO 8601 date that exists, else null. A time without
    a zone is read as UTC."""
    part = lambda k: F.regexp_extract(text, _ISO, k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("int"), F.lit(0))
    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")
    millis = F.rpad(F.substring(part(7), 1, 3), 3, "0").cast("int")
    offset = F.when(part(9) == "-", -1).otherwise(1) * (number(10) * 60 + number(11)) * 60_000
    of_day = (number(4) * 3600 + number(5) * 60 + number(6)).cast("long") * 1000 + millis - offset
    exists = day.isNotNull() & (number(4) <= 23) & (number(5) <= 59) & (number(6) <= 59) & (number(10) <= 23) & (number(11) <= 59)
    found = F.struct((F.unix_date(day).cast("long") * 86_400_000 + of_day).alias("epoch_ms"), (part(4) != "").alias("has_time"), (part(8) != "").alias("has_zone"))
    return F.when(text.rlike(_ISO) & exists, found)


def instant_of(text: Column) -> Column:
    """Milliseconds of the instant that a declared date names, else null. What looks like ISO is read as that
    alone; other forms that pages write are a month's name with day and year."""
    bare = F.regexp_replace(text, "^[A-Za-z]+, ", "")
    lenient = [F.try_to_timestamp(bare, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss Z")]
    other = F.unix_millis(F.coalesce(*lenient))
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}"), read_iso_date(text)["epoch_ms"]).otherwise(other)


#: Days of a history range without a start, and the most of any.
DEFAULT_DAYS, MOST_DAYS = 30, 366
PRESETS = {"7d": 7, "30d": 30, "90d": 90, "12m": 365}


def history_range(first: Column, last: Column, today: Column) -> Column:
    """struct(from, to) of a requested range of days, null where it is refused: no end or one in the future is
    today, no start is 30 days back; a range may not be reversed or longer than MOST_DAYS."""
    to = F.least(F.coalesce(last, today), today)
    start = F.coalesce(first, F.date_sub(to, DEFAULT_DAYS - 1))
    return F.when((start <= to) & (F.datediff(to, start) < MOST_DAYS), F.struct(start.alias("from"), to.alias("to")))


def preset_range(preset: Column, first: Column, last: Column, today: Column) -> Column:
    """struct(from, to) of a preset or of a custom choice, whose ends may come in either order; a custom choice
    without both ends is the last 30 days."""
    days = F.lit(PRESETS["30d"])
    for name, n in PRESETS.items():
        days = F.when(preset == name, n).otherwise(days)
    back = F.struct(F.date_sub(today, days - 1).alias("from"), today.alias("to"))
    return F.when((preset == "custom") & first.isNotNull() & last.isNotNull(), F.struct(F.least(first, last).alias("from"), F.greatest(first, last).alias("to"))).otherwise(back)


def is_time_zone(name: Column) -> Column:
    """Whether a name is that of a time zone; each batch asks for its distinct names once."""
    @F.pandas_udf("boolean")
    def known(names: pd.Series) -> pd.Series:
        from zoneinfo import ZoneInfo

        def one(x: str | None) -> bool:
            try:
                return bool(x) and ZoneInfo(x) is not None
            except (ValueError, KeyError, OSError):
                return False

        return names.map({x: one(x) for x in names.unique()}).astype(bool)

    return F.coalesce(known(F.coalesce(name, F.lit(""))), F.lit(False))
