"""Dates in text, Column to Column. today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions import constants as C

_EN, _RU = "|".join(C.MONTHS_EN), "|".join(C.MONTHS_RU)


def _month(name: Column, months: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, months)), F.lower(name)).cast("int")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("int").cast("string"), 2, "0"))


def date_in(text: Column, fallback_year: int) -> Column:
    """The first date that is found as ISO, day.month.year, Russian or English month names; a year that is not told is fallback_year."""
    g = lambda p, k: F.regexp_extract(text, p, k)
    year = lambda p, k: F.when(g(p, k) == "", F.lit(str(fallback_year))).otherwise(g(p, k))
    iso = r"(\d{4}-\d{2}-\d{2})"
    dotted = r"(\d{1,2})\.(\d{2})\.(\d{4})"
    ru = rf"(?iu)(\d{{1,2}})\s+({_RU})(?:\s+(\d{{4}}))?"
    month_first = rf"(?i)({_EN})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:[,\s]+(\d{{4}}))?"
    day_first = rf"(?i)(\d{{1,2}})(?:st|nd|rd|th)?\s+({_EN})(?:\s+(\d{{4}}))?"
    day, month = F.try_to_number(g(dotted, 1), F.lit("99")), F.try_to_number(g(dotted, 2), F.lit("99"))
    return F.coalesce(
        F.when(text.rlike(iso), g(iso, 1)),
        F.when(text.rlike(dotted) & month.between(1, 12) & day.between(1, 31), _iso(g(dotted, 3), month.cast("int"), day)),
        F.when(text.rlike(ru), _iso(year(ru, 3), _month(g(ru, 2), C.MONTHS_RU), g(ru, 1))),
        F.when(text.rlike(month_first), _iso(year(month_first, 3), _month(g(month_first, 1), C.MONTHS_EN), g(month_first, 2))),
        F.when(text.rlike(day_first), _iso(year(day_first, 3), _month(g(day_first, 2), C.MONTHS_EN), g(day_first, 1))),
    )


def date_range_in(text: Column, today: Column) -> Column:
    """struct<start, end> that a relative expression means on the day today; null if there is none. The first rule that matches counts."""
    x = F.lower(text)
    has = lambda p: x.rlike("(?U)" + p)
    span = lambda a, b: F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))
    monday = F.date_trunc("week", today).cast("date")
    first = F.trunc(today, "month")
    last_year = F.add_months(F.trunc(today, "year"), -12)
    back = lambda n: F.date_sub(today, n)
    number = lambda p: F.coalesce(F.regexp_extract(x, p, 1).try_cast("int"), F.lit(0))
    this_week, this_month = span(monday, F.date_add(monday, 6)), span(first, F.last_day(today))
    prior_week, prior_month = span(F.date_sub(monday, 7), F.date_sub(monday, 1)), span(F.add_months(first, -1), F.date_sub(first, 1))
    prior_year = span(last_year, F.date_sub(F.trunc(today, "year"), 1))
    ru_days, en_days = r"последни[а-я]*\s+(\d+)\s+дн", r"last\s+(\d+)\s+days?"
    ru_span = rf"с\s+(\d{{1,2}})\s+по\s+(\d{{1,2}})\s+({_RU})(?:\s+(\d{{4}}))?"
    g = lambda k: F.regexp_extract(x, ru_span, k)
    year = F.when(g(4) == "", F.year(today).cast("string")).otherwise(g(4))
    on = lambda k: F.try_to_date(_iso(year, _month(g(3), C.MONTHS_RU), g(k).try_cast("int")))
    rules = [
        (has(r"this\s+week|current\s+week"), this_week), (has(r"this\s+month|current\s+month"), this_month),
        (has(r"эт\w*\s+недел|текущ\w*\s+недел|на\s+этой\s+неделе"), this_week), (has(r"эт\w*\s+месяц|текущ\w*\s+месяц|в\s+этом\s+месяце"), this_month),
        (has(r"прошл\w*\s+год|в\s+прошлом\s+году|последн\w*\s+год"), prior_year), (has(r"прошл\w*\s+месяц|в\s+прошлом\s+месяце|последн\w*\s+месяц"), prior_month),
        (has(r"последн\w*\s+недел|прошл\w*\s+недел|на\s+прошлой\s+неделе"), prior_week), (x.rlike(ru_days), span(back(number(ru_days)), today)),
        (x.contains("позавчера"), span(back(2), back(2))), (x.contains("вчера"), span(back(1), back(1))), (x.contains("сегодня"), span(today, today)), (x.rlike(ru_span), span(on(1), on(2))),
        (x.contains("last year"), prior_year), (x.contains("last month"), prior_month), (x.contains("last week"), prior_week), (x.contains("yesterday"), span(back(1), back(1))), (x.contains("today"), span(today, today)),
        (x.rlike(en_days), span(back(number(en_days)), today)),
    ]
    for names, mark in ((C.DAYS_RU, "прошл|последн"), ({d: k for k, d in enumerate(C.DAYS_EN)}, "last")):
        for name, k in names.items():
            n = F.pmod(F.weekday(today) - F.lit(k), F.lit(7))
            n = F.when(n == 0, 7).otherwise(n)
            rules.append((x.contains(name) & x.rlike(mark), span(back(n), back(n))))
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out


def explicit_range(text: Column, today: Column, fallback_year: int) -> Column:
    """'a..b' of ISO dates, else a relative range, else a single date as a range of one day."""
    p = r"(\d{4}-\d{2}-\d{2})\s*\.\.\s*(\d{4}-\d{2}-\d{2})"
    pair = F.struct(F.try_to_date(F.regexp_extract(text, p, 1)).alias("start"), F.try_to_date(F.regexp_extract(text, p, 2)).alias("end"))
    one = F.try_to_date(date_in(text, fallback_year))
    return F.coalesce(F.when(text.rlike(p), pair), date_range_in(text, today), F.when(one.isNotNull(), F.struct(one.alias("start"), one.alias("end"))))


def dates_between(start: Column, end: Column) -> Column:
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def document_date(title: Column, content: Column, updated: Column, created: Column, fallback_year: int) -> Column:
    """Date in the title, else in the first 500 characters, else of the last change, else of the creation."""
    return F.coalesce(date_in(title, fallback_year), date_in(F.substring(content, 1, 500), fallback_year), F.date_format(updated, "yyyy-MM-dd"), F.date_format(created, "yyyy-MM-dd"))


def recency(updated: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """Halves each half_life_days; 1 where there is no date or it lies ahead."""
    age = F.greatest((F.unix_micros(now) - F.unix_micros(updated)) / 86_400e6, F.lit(0.0))
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) / half_life_days * age), F.lit(1.0))
