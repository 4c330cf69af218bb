"""Dates as ISO text: validation, anchors and closeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreweave.functions.text import years, words_of

# Full and short month names in order.
MONTHS = "january february march april may june july august september october november december".split()
DAY = r"(?<![0-9-])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9-])"


def is_date(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c).isNotNull()


def is_date_or_range(c: Column) -> Column:
    """A date, or two joined by .. of which the first is not later."""
    a, b = F.split_part(c, F.lit(".."), F.lit(1)), F.split_part(c, F.lit(".."), F.lit(2))
    return F.coalesce(is_date(c) | (c.contains("..") & is_date(a) & is_date(b) & (a <= b)), F.lit(False))


def first_day(c: Column) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(DAY), 1), lambda x: F.try_to_date(x)), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def month_number(t: Column) -> Column:
    t = F.lower(t)
    out = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS, 1):
        out = F.when((t == name) | (t == name[:3]), i).otherwise(out)
    return F.when(t == "sept", 9).otherwise(out)


def _month_anchor(c: Column) -> Column:
    w = words_of(c)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def month(p: Column) -> Column:
        year = lambda x: F.when(x.rlike("^(19|20)[0-9]{2}$"), x.cast("int"))
        return F.coalesce(F.make_date(year(p["b"]), month_number(p["a"]), F.lit(1)), F.make_date(year(p["a"]), month_number(p["b"]), F.lit(1)))

    return F.get(F.filter(F.transform(pairs, month), lambda x: x.isNotNull()), F.lit(0))


def query_anchor(c: Column) -> Column:
    """struct(date, precision) of the first day, else month with year, else year that a question names."""
    day, month = first_day(c), _month_anchor(c)
    year = F.make_date(F.get(years(c), F.lit(0)).cast("int"), F.lit(1), F.lit(1))
    return F.struct(F.coalesce(day, month, year).alias("date"), F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").when(year.isNotNull(), "year").alias("precision"))


def event_date(c: Column) -> Column:
    return F.coalesce(first_day(c), F.make_date(F.get(years(c), F.lit(0)).cast("int"), F.lit(1), F.lit(1)))


def proximity(anchor: Column, event: Column) -> Column:
    """8 less a point a week from a day, 6 less the months from a month, 4 less the years from a year; never below 0."""
    q, kind = anchor["date"], anchor["precision"]
    days = F.abs(F.datediff(q, event)).cast("double")
    months = (F.abs(F.year(q) - F.year(event)) * 12 + F.abs(F.month(q) - F.month(event))).cast("double")
    apart = F.abs(F.year(q) - F.year(event)).cast("double")
    near = F.when(kind == "day", 8.0 - days / 7.0).when(kind == "month", 6.0 - months).when(kind == "year", 4.0 - apart)
    return F.coalesce(F.greatest(near, F.lit(0.0)), F.lit(0.0))


def half_life(age_days: Column, days: float) -> Column:
    return F.pow(F.lit(0.5), age_days / max(days, 0.0001))
