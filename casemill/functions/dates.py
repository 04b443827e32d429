"""Dates: strict parsing, whole years, working days and deadlines; ``now`` is always an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions.text import stripped


def iso_date(text: Column) -> Column:
    """A date of the shape 2026-01-31 after trimming; anything else is null."""
    bare = stripped(text)
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(bare, "yyyy-MM-dd"))


def full_years(earlier: Column, later: Column) -> Column:
    """Years completed; one less if the day of the year is not reached.  Negative for swapped arguments."""
    borrow = (F.month(later) * 100 + F.dayofmonth(later)) < (F.month(earlier) * 100 + F.dayofmonth(earlier))
    return F.year(later) - F.year(earlier) - F.when(borrow, 1).otherwise(0)


def signed_years(earlier: Column, later: Column) -> Column:
    """Years of 365.25 days, to six places, negative if ``later`` is before ``earlier``."""
    return F.bround(F.datediff(later, earlier) / F.lit(365.25), 6)


def birth_block(block: Column) -> Column:
    """The day of a block DDMMYY in 19YY; null if there is none."""
    return F.when(block.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(F.substring(block, 1, 4), F.lit("19"), F.substring(block, 5, 2)), "ddMMyyyy"))


def is_working_day(day: Column, holidays: Sequence[str] = ()) -> Column:
    free = F.weekday(day) >= 5
    return ~free & ~day.cast("string").isin(*holidays) if holidays else ~free


def next_working_day(day: Column, holidays: Sequence[str] = ()) -> Column:
    """The first working day from ``day`` within eight days; null if there is none."""
    days = F.sequence(day, F.date_add(day, 7))
    return F.get(F.filter(days, lambda d: is_working_day(d, holidays)), F.lit(0))


def delivery_date(sent: Column, holidays: Sequence[str] = (), days: int = 4) -> Column:
    """When a posted decision counts as delivered."""
    return next_working_day(F.date_add(sent, days), holidays)


def response_deadline(sent: Column, window_days: int, holidays: Sequence[str] = ()) -> Column:
    if window_days < 1:
        raise ValueError("a response window has at least one day")
    return next_working_day(F.date_add(delivery_date(sent, holidays), window_days), holidays)


def age_hours(received: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(received)) / F.lit(3600.0)


def age_label(received: Column, now: Column) -> Column:
    """Minutes below an hour, hours below two days, else days; null if the receipt is unknown."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(received)
    part = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(" " + unit))
    return F.when(seconds < 3600, part(60, "min")).when(seconds < 2 * 86400, part(3600, "h")).otherwise(part(86400, "d"))


def shifted_days(day: Column, holidays: Sequence[str] = ()) -> Column:
    """The days from ``day`` on that a deadline skips before the next working day."""
    last = next_working_day(day, holidays)
    return F.filter(F.sequence(day, F.date_add(day, 7)), lambda d: d < last)


def remaining_days(due: Column, now: Column) -> Column:
    return (F.unix_timestamp(due) - F.unix_timestamp(now)) / F.lit(86400.0)


def waited_seconds(decided: Column, confirmed: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(confirmed) - F.unix_timestamp(decided))


def rendered_day(at: Column) -> Column:
    return F.date_format(at, "dd.MM.yyyy")


def rendered_time(at: Column) -> Column:
    return F.date_format(at, "dd.MM.yyyy HH:mm")
