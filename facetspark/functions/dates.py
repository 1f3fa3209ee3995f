"""Dates and times found in texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: A date, with a time of day where one follows.
ISO = r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?))?"
YEAR = r"\b(?:19|20)\d{2}\b"
HISTORY = (  # Fixed values: what makes a question one about the past.
    r"\b(before|previous|previously|formerly|used to|at the time|history|historical|when|changed|changes|evolved|timeline|ever|between|how many times)\b"
    r"|\b(?:19|20)\d{2}\b"
)


def iso_date(text: Column) -> Column:
    """The first date of the form 2024-01-31; null where there is none."""
    return F.nullif(F.regexp_extract(text, ISO, 1), F.lit(""))


def iso_time(text: Column) -> Column:
    """The time of day that follows the first date."""
    return F.nullif(F.regexp_extract(text, ISO, 2), F.lit(""))


def chat_time(text: Column) -> Column:
    """The moment that `1:56 pm on 8 May, 2023` names; null where the text has another form."""
    return F.try_to_timestamp(F.upper(F.trim(text)), F.lit("h:mm a 'ON' d MMMM, yyyy"))


# The names of months, by their first letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
_DAY, _YEAR = r"\b(\d{1,2})(?:st|nd|rd|th)?", r"((?:19|20)\d{2})\b"
#: How a date may stand in a text, in the order in which the forms are tried, with the places of year, month and day in each; 0 where missing.
FORMS = (
    (rf"\b{_YEAR}[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?!\d)", 1, 2, 3),
    (rf"{_DAY}[\s,-]*(?:of\s+)?{_MONTH}[\s,-]*{_YEAR}", 3, 2, 1),
    (rf"\b{_MONTH}[\s,-]*{_DAY}(?:\s*,\s*|\s+|-){_YEAR}", 3, 1, 2),
    (rf"\b{_YEAR}[\s,-]+{_MONTH}[\s,-]*{_DAY}\b", 1, 2, 3),
    (rf"\b(\d{{1,2}})[-/.](\d{{1,2}})[-/.]{_YEAR}", 3, 1, 2),
    (rf"\b(\d{{1,2}})[-/.](\d{{1,2}})[-/.]{_YEAR}", 3, 2, 1),
    (rf"\b{_MONTH}[\s,-]*(?:of\s+)?{_YEAR}", 2, 1, 0),
    (rf"\b{_YEAR}[\s,-]*{_MONTH}", 1, 2, 0),
    (rf"\b{_YEAR}[-/](\d{{1,2}})(?!\d)", 1, 2, 0),
    (rf"\b(\d{{1,2}})[-/]{_YEAR}", 2, 1, 0),
    (rf"\b{_YEAR}", 1, 0, 0),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def date_with_year(text: Column) -> Column:
    """The first date in running text that names a year of 1900 to 2099; null without such a year.

    Forms are tried from the fullest to the barest: 2023-05-08, 2023/05/08, 8 May 2023, 8th of May, 2023, Sept 3, 2021,
    05/08/2023 (month first; day first where that is no date), May 2023, 2023-05, 05/2023, in 2021. A missing month or day is the
    first. What is no date, as 31 February, doesn't count, and barer forms are tried.
    """
    lower = F.lower(text)
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])

    def date(low: Column, pattern: str, year: int, month: int, day: int) -> Column:
        get = lambda i: F.regexp_extract(low, pattern, i)
        named = lambda c: F.coalesce(c.try_cast("int"), F.try_element_at(number, F.substring(c, 1, 3)))
        parts = F.struct(
            get(year).try_cast("int").alias("y"), (bound(get(month), named) if month else F.lit(1)).alias("m"), (get(day).try_cast("int") if day else F.lit(1)).alias("d")
        )
        return F.when(low.rlike(pattern), bound(parts, made))

    def made(p: Column) -> Column:
        # a day beyond its month comes out in another month, so the parts are compared afterwards
        at = F.date_add(F.add_months(F.lit("1900-01-01").cast("date"), (p["y"] - 1900) * 12 + p["m"] - 1), p["d"] - 1)
        return F.when((p["m"] >= 1) & (p["m"] <= 12) & (p["d"] >= 1), bound(at, lambda x: F.when(F.month(x) == p["m"], x)))

    return F.when(text.rlike(YEAR), bound(F.lower(text), lambda low: F.coalesce(*[date(low, *form) for form in FORMS])))


def asks_for_history(question: Column) -> Column:
    return F.lower(question).rlike(HISTORY)


def date_range(start: Column, end: Column) -> Column:
    """`start to end`, with unknown and present for what is missing."""
    return F.concat(F.coalesce(start, F.lit("unknown")), F.lit(" to "), F.coalesce(end, F.lit("present")))
