"""Five-field cron expressions: the last minute before a time at which one fires."""

from __future__ import annotations

import calendar
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the macros stand for, and names of months and days.
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = {n.lower(): i for i, n in enumerate(calendar.month_abbr) if n}
DAYS = {"sun": 0, "mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6}
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: Years to look back before giving up on an expression that never fires.
YEARS = 30


def field(text: str, lo: int, hi: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = lo, hi
        else:
            first, dash, second = span.partition("-")
            a = names[first] if first in names else int(first)
            b = (names[second] if second in names else int(second)) if dash else hi if step else a
        jump = int(step) if step else 1
        if not (lo <= a <= b <= hi) or jump < 1:
            raise ValueError(f"bad cron field {text!r}")
        out.update(range(a, b + 1, jump))
    return out


def parse(expression: str) -> tuple[set[int], ...]:
    """Minutes, hours, days, months and weekdays (Sunday is 0), and whether days and weekdays are both bound."""
    parts = MACROS.get(expression.strip().lower(), expression).split()
    if len(parts) != 5:
        raise ValueError(f"bad cron expression {expression!r}")
    found = [field(p, lo, hi, names) for p, (lo, hi), names in zip(parts, RANGES, ({}, {}, {}, MONTHS, DAYS))]
    found[4] = {d % 7 for d in found[4]}
    return (*found, {int(parts[2][0] != "*" and parts[4][0] != "*")})


def previous(expression: str, when: datetime) -> datetime | None:
    """The latest time before when, in its zone, at which the expression fires; None within 30 years back."""
    minutes, hours, days, months, weekdays, either = parse(expression)
    now = (when - timedelta(microseconds=1)).replace(second=0, microsecond=0)
    first = now.year - YEARS
    day = now.date()
    while day.year >= first:
        by_day, by_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        if day.month not in months:
            day = day.replace(day=1) - timedelta(days=1)
            continue
        if (by_day or by_week) if either == {1} else (by_day and by_week):
            for h in sorted(hours, reverse=True):
                for m in sorted(minutes, reverse=True):
                    at = datetime(day.year, day.month, day.day, h, m, tzinfo=now.tzinfo)
                    if at <= now:
                        return at
        day -= timedelta(days=1)
    return None


#: The years that a calendar has a row for each day of.
FIRST_YEAR, LAST_YEAR = 1970, 2100


def eligible(fields: tuple[set[int], ...], day: date) -> bool:
    """Whether an expression can fire on a day."""
    _, _, days, months, weekdays, either = fields
    by_day, by_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
    return day.month in months and ((by_day or by_week) if either == {1} else (by_day and by_week))


def with_previous(df: DataFrame, expression: str, when: Column, zone: str = "UTC", to: str = "fired") -> DataFrame:
    """Add the latest time before an instant at which an expression fires, on the clocks of a zone, as a time without one.

    A calendar of days with the last day before each that the expression fires on is broadcast: a row for each day
    of a fixed span of years. Times of the day are a literal array. Null for times outside the span or before the
    first firing.
    """
    fields = parse(expression)
    rows, last, day = [], None, date(FIRST_YEAR, 1, 1)
    while day.year <= LAST_YEAR:
        fires = eligible(fields, day)
        rows.append((day, fires, last))
        last = day if fires else last
        day += timedelta(days=1)
    days = F.broadcast(df.sparkSession.createDataFrame(rows, "cron_day date, cron_fires boolean, cron_last date"))
    minutes = sorted(60 * h + m for h in fields[1] for m in fields[0])
    clock = F.from_utc_timestamp(F.to_utc_timestamp(when, F.current_timezone()), zone) - F.expr("INTERVAL 0.000001 SECOND")
    kept = df.drop(to).select(F.struct("*").alias("cron_row"), clock.alias("cron_now"))
    found = kept.join(days, F.to_date("cron_now") == F.col("cron_day"), "left")
    now = F.hour("cron_now") * 60 + F.minute("cron_now")
    past = F.array_max(F.filter(F.array(*map(F.lit, minutes)), lambda m: m <= now))
    at = lambda day, minute: F.to_timestamp_ntz(F.concat(F.date_format(day, "yyyy-MM-dd "), F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"), F.lit(":00")))
    fired = F.when(F.col("cron_fires") & past.isNotNull(), at(F.col("cron_day"), past)).otherwise(at(F.col("cron_last"), F.lit(minutes[-1])))
    return found.select(*(F.col("cron_row").getField(c).alias(c) for c in df.columns if c != to), fired.alias(to))
