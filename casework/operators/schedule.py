"""Schedules and dated measurements read out of texts; patterns and ranges are arguments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScheduleWords:
    """What to look for, in folded (lower-case, unaccented) text: a stated weekly number as first group, the names of days in order, a
    heading that numbers sessions as first group, and patterns of kinds and of parts."""

    stated: str
    days: Sequence[str]
    session: str
    kinds: dict[str, str]
    parts: dict[str, str]


def _named(text: Column, patterns: dict[str, str]) -> Column:
    found = F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in sorted(patterns.items())]).cast("array<string>")
    return F.array_join(F.array_compact(found), ",")


def extract_schedule(texts: DataFrame, words: ScheduleWords, *, key: str, text: str) -> DataFrame:
    """(key, per_week, source, days, sessions, kinds, parts): how often a week, and by which evidence.

    A number that is stated counts before the different days that are named, these before the different sessions that are headed; ``source``
    is ``stated``, ``days`` or ``sessions``, null with ``per_week`` where nothing is said. Days come in the order of the week, kinds and parts by name."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    stated = F.regexp_extract(body, words.stated, 1).try_cast("int")
    days = F.array_compact(F.array(*[F.when(body.rlike(rf"(^|[^a-z]){d}([^a-z]|$)"), F.lit(d)) for d in words.days]).cast("array<string>"))
    sessions = F.array_distinct(F.regexp_extract_all(body, F.lit(words.session), F.lit(1)))
    rows = texts.select(F.col(key), stated.alias("stated"), days.alias("d"), F.size(sessions).alias("sessions"), _named(body, words.kinds).alias("kinds"), _named(body, words.parts).alias("parts"))
    n_days = F.nullif(F.size("d"), F.lit(0))
    n_sessions = F.nullif(F.col("sessions"), F.lit(0))
    source = F.when(F.col("stated").isNotNull(), "stated").when(n_days.isNotNull(), "days").when(n_sessions.isNotNull(), "sessions")
    return rows.select(key, F.coalesce("stated", n_days, n_sessions).alias("per_week"), source.alias("source"), F.array_join("d", ",").alias("days"), "sessions", "kinds", "parts")


def date_in(text: Column, *, pivot: int = 70, months: Sequence[str] = ()) -> Column:
    """The first date in a text, as ISO (2024-03-01), day first (1/3/2024, 01.03.24) or with a month's name (1 march 2024): the first of
    these kinds that is there. Years of two digits below ``pivot`` are of this century; a day that does not exist gives null."""
    iso = [F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[^0-9]|$)", i) for i in (1, 2, 3)]
    day_first = [F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4}|[0-9]{2})(?:[^0-9]|$)", i) for i in (3, 2, 1)]
    kinds = [iso, day_first]
    if months:
        named = rf"(?i)(?:^|[^0-9])([0-9]{{1,2}})\.? (?:de )?({'|'.join(months)}),? (?:de )?([0-9]{{4}})(?:[^0-9]|$)"
        month = F.array_position(F.array(*[F.lit(m.lower()) for m in months]), F.lower(F.regexp_extract(text, named, 2)))
        kinds.append([F.regexp_extract(text, named, 3), F.when(month > 0, month.cast("string")).otherwise(""), F.regexp_extract(text, named, 1)])

    def built(year: Column, month: Column, day: Column) -> Column:
        y = year.try_cast("int")
        full = F.when(F.length(year) == 2, F.when(y < pivot, y + 2000).otherwise(y + 1900)).otherwise(y)
        return F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    found = F.lit(None).cast("string")
    for year, month, day in reversed(kinds):
        found = F.when(year != "", built(year, month, day)).otherwise(found)
    return F.try_to_date(found, "yyyy-MM-dd")


def dated_measures(texts: DataFrame, measures: dict[str, tuple[str, float, float]], *, key: str, text: str, first_year: int, last_year: int) -> DataFrame:
    """(key, line, date, *measures): the lines of a text that hold a date and at least one measure within its range.

    ``measures``: name to a pattern with the number as its first group, and the least and largest value that can be true; others
    become null, and a line without any goes. Dates outside the years are no dates."""
    lines = texts.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "__text"))
    values = []
    for name, (pattern, low, high) in measures.items():
        value = F.replace(F.regexp_extract(F.lower("__text"), pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        values.append(F.when(value.between(low, high), value).alias(name))
    rows = lines.select(key, "line", date_in(F.col("__text")).alias("date"), *values)
    return rows.filter(F.year("date").between(first_year, last_year) & F.coalesce(*measures).isNotNull())
