"""Clock arithmetic on timestamp columns (with or without time zone; the session zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / 3.6e9


def days_between(start, end) -> Column:
    return (micros(end) - micros(start)) / 8.64e10


def iso_duration_seconds(c) -> Column:
    """Seconds of a positive ISO-8601 duration P[nD][T[nH][nM][nS]]; null if it is none, or not above zero."""
    text, total = col(c), F.lit(0)
    for unit, seconds in (("([0-9]+)D", 86400), ("T(?:.*?)([0-9]+)H", 3600), ("T(?:.*?)([0-9]+)M", 60), ("T(?:.*?)([0-9]+)S", 1)):
        total = total + F.coalesce(F.expr("1") * F.nullif(F.regexp_extract(text, unit, 1), F.lit("")).cast("long"), F.lit(0)) * seconds
    valid = text.rlike("^P(?=[0-9T])([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+S)?)?$")
    return F.when(valid & (total > 0), total)


def iso_instant(c) -> Column:
    """An ISO timestamp that carries its offset, in UTC to whole seconds; null without an offset."""
    text = col(c)
    return F.when(text.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), F.date_trunc("second", F.try_to_timestamp(text)))


def stage_cutoff(kickoff, hour: int, minute: int = 0) -> Column:
    """The kickoff's date at a fixed local time."""
    return F.date_trunc("day", col(kickoff).cast("timestamp")) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
