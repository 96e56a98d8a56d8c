"""Dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "MMMM d, yyyy"]
FAR_PAST, FAR_FUTURE, NO_ANCHOR = "2000-01-01", "2099-12-31", 1_000_000_000


def any_date(x: Column, formats: list[str] = FORMATS) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.try_to_date(x, f) for f in formats])


def in_force(day: Column, proposed: Column, decided: Column, last_activity: Column, before: int = 540, after: int = 180) -> Column:
    """Whether a day lies between proposal - before and decision + after; without a decision the last activity ends it.

    Open ends are far away; a null day, or a file without any date, rules nothing out.
    """
    low = F.coalesce(F.date_sub(proposed, before), F.lit(FAR_PAST).cast("date"))
    high = F.coalesce(F.date_add(decided, after), F.date_add(last_activity, after), F.lit(FAR_FUTURE).cast("date"))
    return day.isNull() | (proposed.isNull() & decided.isNull() & last_activity.isNull()) | ((day >= low) & (day <= high))


def nearest_anchor(day: Column, *anchors: Column) -> Column:
    """Days to the nearest of some dates; NO_ANCHOR where there is none."""
    return F.coalesce(F.array_min(F.array(*[F.abs(F.datediff(day, a)) for a in anchors])), F.lit(NO_ANCHOR))


def week_start(day: Column, first: str = "2024-07-16") -> Column:
    """The first day of the seven-day partition a day belongs to, counted from `first`."""
    return F.date_add(F.lit(first).cast("date"), (F.floor(F.datediff(day, F.lit(first).cast("date")) / 7) * 7).cast("int"))


def recent(day: Column, today: Column, days: int = 28) -> Column:
    return F.when(day >= F.date_sub(today, days), "recent").otherwise("settled")
