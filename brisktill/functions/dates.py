"""Calendar keys, labels and pushed-down date ranges."""

from datetime import date, timedelta

from pyspark.sql import functions as F


def as_date(value):
    """A `date` from a date or a yyyy-mm-dd text."""
    return value if isinstance(value, date) else date.fromisoformat(value)


def in_days(ts, start, end):
    """Timestamps from the start of `start` to the end of `end`, as a half-open range a scan can use."""
    first, after = as_date(start), as_date(end) + timedelta(days=1)
    return (ts >= F.lit(first)) & (ts < F.lit(after))


def day_range(ts, start=None, end=None):
    """`in_days` when both ends are given, else None: a range with one end is ignored."""
    return in_days(ts, start, end) if start and end else None


def month_bounds(day):
    """First and last day of the month of `day`."""
    first = as_date(day).replace(day=1)
    following = (first + timedelta(days=31)).replace(day=1)
    return first, following - timedelta(days=1)


def iso_yearweek(ts):
    """Year of the ISO week times 100 plus the week, for example 202501."""
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)).cast("int")


def week_label(ts):
    return F.concat(F.date_format(ts, "yyyy"), F.lit(" Week "), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


# grouping -> (key of a timestamp, label of the earliest timestamp in the group).
# A week that spans the new year could carry either year; the earliest bill decides.
PERIODS = {
    "day": (F.to_date, lambda ts: F.date_format(ts, "yyyy-MM-dd")),
    "week": (iso_yearweek, week_label),
    "month": (lambda ts: F.date_format(ts, "yyyy-MM"), lambda ts: F.date_format(ts, "yyyy-MM")),
    "year": (F.year, lambda ts: F.date_format(ts, "yyyy")),
}


def period(group_by):
    """Key and label functions; an unknown grouping means by day."""
    return PERIODS.get(group_by, PERIODS["day"])
