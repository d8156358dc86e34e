"""Dates and times from foreign text, as Column functions. Nothing here reads the clock; "today" is a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlode.functions.text import once

#: English month names by their first three letters, and Hebrew ones.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
HEBREW_MONTHS = ["ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר"]
#: Times of an event that tells none.
START_TIME, END_TIME = "20:00", "22:30"


def _date(y: Column, m: Column, d: Column) -> Column:
    """Null on an invalid day, where make_date would raise."""
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def day_first(text: Column, today: dt.date) -> Column:
    """D.M.Y, D/M/Y, two-digit years after 2000; without a year the next such day from `today` on."""
    full = lambda i: F.regexp_extract(text, r"(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})\b", i)
    short = lambda i: F.regexp_extract(text, r"(\d{1,2})[./](\d{1,2})", i)
    year = F.when(F.length(full(3)) == 2, F.concat(F.lit("20"), full(3))).otherwise(full(3))
    this = _date(F.lit(str(today.year)), short(2), short(1))
    rolled = F.when(this < F.lit(today), _date(F.lit(str(today.year + 1)), short(2), short(1))).otherwise(this)
    return F.when(full(1) != "", _date(year, full(2), full(1))).when(short(1) != "", rolled)


def month_name(text: Column, today: dt.date) -> Column:
    """"May 1st, 2026" or "1 May": a month name with a day on either side; without a year, this year's."""
    return once(F.regexp_replace(F.lower(text), r"(\d)(?:st|nd|rd|th)\b", "$1"), lambda plain: _named_month(plain, today))


def _named_month(plain: Column, today: dt.date) -> Column:
    names = "|".join(MONTHS)
    month_day = lambda i: F.regexp_extract(plain, rf"\b({names})[a-z]*\.?\s+(\d{{1,2}})\b(?:,?\s+(\d{{4}}))?", i)
    day_month = lambda i: F.regexp_extract(plain, rf"\b(\d{{1,2}})\s+({names})[a-z]*\.?(?:,?\s+(\d{{4}}))?", i)
    number = lambda c: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), c).cast("string")
    year = lambda c: F.when(c != "", c).otherwise(F.lit(str(today.year)))
    first = F.when(month_day(1) != "", _date(year(month_day(3)), number(month_day(1)), month_day(2)))
    return F.coalesce(first, F.when(day_month(1) != "", _date(year(day_month(3)), number(day_month(2)), day_month(1))))


def hebrew_date(text: Column, today: dt.date) -> Column:
    """"14 מרץ 2026"; without a year, this year's."""
    names = "|".join(HEBREW_MONTHS)
    part = lambda i: F.regexp_extract(text, rf"(\d{{1,2}})\s+ב?({names})\s*(\d{{4}})?", i)
    number = F.array_position(F.array(*map(F.lit, HEBREW_MONTHS)), part(2)).cast("string")
    return F.when(part(1) != "", _date(F.when(part(3) != "", part(3)).otherwise(F.lit(str(today.year))), number, part(1)))


def date_range(text: Column, today: dt.date) -> Column:
    """struct(start, end) of "May 1st, 2026 to May 2nd, 2026"; without an end both are the start."""
    sides = F.split(text, r"(?i)\s+to\s+", 2)
    start = any_date(F.get(sides, F.lit(0)), today)
    return F.struct(start.alias("start"), F.coalesce(any_date(F.get(sides, F.lit(1)), today), start).alias("end"))


def clock_12(text: Column) -> Column:
    """HH:MM of a time with or without am and pm; the default time where there is none or it is out of bounds."""
    part = lambda i: F.regexp_extract(F.lower(text), r"(\d{1,2}):(\d{2})\s*(am|pm)?", i)
    h = part(1).try_cast("int")
    hour = F.when((part(3) == "pm") & (h < 12), h + 12).when((part(3) == "am") & (h == 12), 0).otherwise(h)
    return F.when(hour.between(0, 23), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2))).otherwise(F.lit(START_TIME))


def date_and_times(date_text: Column, time_text: Column, today: dt.date) -> Column:
    """struct(start_date, start_time, end_time): ISO, then month name, then day first; a date that is over is null, times have defaults."""
    found = once(date_text, lambda t: F.coalesce(iso_date(t), month_name(t, today), day_first(t, today)))
    return F.struct(once(found, lambda d: F.when(d >= F.lit(today), d)).alias("start_date"), F.coalesce(clock_12(time_text), F.lit(START_TIME)).alias("start_time"), F.lit(END_TIME).alias("end_time"))


def zulu(text: Column) -> Column:
    """An ISO timestamp, Z or an offset minded; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def epoch(number: Column, zone: str = "UTC") -> Column:
    """A timestamp of epoch seconds, or milliseconds where the number is too large for these, in a zone."""
    n = number.try_cast("double")
    return F.from_utc_timestamp(F.timestamp_millis(F.when(n >= 100_000_000_000, n).otherwise(n * 1000).cast("long")), zone)


def months_later(date: Column, n: int) -> Column:
    """The same day n months later; a day that the month lacks becomes its last."""
    return F.add_months(date, n)


def racing_years(month: Column, year: Column) -> Column:
    """This year, and in the last quarter the next one too."""
    return F.when(month >= 10, F.array(year, year + 1)).otherwise(F.array(year))


def any_date(text: Column, today: dt.date) -> Column:
    """The first reading that works: ISO, month name in either language, day first."""
    return once(text, lambda t: F.coalesce(iso_date(t), month_name(t, today), hebrew_date(t, today), day_first(t, today)))


def clock(text: Column) -> Column:
    """HH:MM within bounds, zero-padded."""
    h, m = F.regexp_extract(text, r"\b(\d{1,2}):(\d{2})\b", 1), F.regexp_extract(text, r"\b(\d{1,2}):(\d{2})\b", 2)
    good = (h != "") & (h.try_cast("int") < 24) & (m.try_cast("int") < 60)
    return F.when(good, F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))


def unless_midnight(time: Column) -> Column:
    return F.nullif(time, F.lit("00:00"))


def default_end(date: Column, time: Column, end_date: Column, hours: int = 2) -> tuple[Column, Column]:
    """A known start time gives the end `hours` later, replacing the end date; else the end date stays without a time."""
    start = F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), time), F.lit("yyyy-MM-dd HH:mm"))
    end = start + F.expr(f"INTERVAL {hours} HOURS")
    return F.when(end.isNotNull(), F.to_date(end)).otherwise(end_date), F.date_format(end, "HH:mm")


def season_years(month: Column, year: Column) -> Column:
    """From July on this season and the last one, before that the last two."""
    return F.when(month >= 7, F.array(year, year - 1)).otherwise(F.array(year - 1, year))
