"""Dates as column expressions; every comparison day is an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and short forms in Indonesian and English.
MONTHS = (
    ("januari january jan", 1), ("februari february feb pebruari", 2), ("maret march mar", 3), ("april apr", 4), ("mei may", 5), ("juni june jun", 6),
    ("juli july jul", 7), ("agustus august aug agu agt", 8), ("september sept sep", 9), ("oktober october oct okt", 10), ("november nopember nov nop", 11), ("desember december dec des", 12),
)
MONTH_NUMBER = {name: n for names, n in MONTHS for name in names.split()}
MONTH_NAMES = tuple(names.split()[0].title() for names, _ in MONTHS)


def month_number(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MONTH_NUMBER.items() for x in pair))
    return F.try_element_at(table, F.lower(name))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def found(text: Column) -> Column:
    """Dates of a text in order of place, repeated ones at every place: array of struct(pos, date)."""
    names = "|".join(sorted(MONTH_NUMBER, key=len, reverse=True))
    worded = rf"(?i)\b([0-3]?[0-9])[ ./-]*({names})[a-z]*[ ./,-]*((?:19|20)[0-9]{{2}})\b"
    numeric = r"\b([0-3]?[0-9])[-/.]([01]?[0-9])[-/.]((?:19|20)[0-9]{2})\b"
    iso = r"\b((?:19|20)[0-9]{2})-([01][0-9])-([0-3][0-9])\b"

    def all_of(pattern: str, make) -> Column:
        # A match stands after what is between the matches before it, and these: both are read off the split text.
        between = F.split(text, pattern, -1)
        matches = F.regexp_extract_all(text, F.lit(pattern), 0)
        start = F.struct(F.lit(1).alias("upto"), F.array().cast("array<struct<pos:int,raw:string>>").alias("out"))

        def step(held: Column, pair: Column) -> Column:
            pos = held["upto"] + F.length(pair["gap"])
            return F.struct(
                (pos + F.length(pair["raw"])).alias("upto"), F.concat(held["out"], F.array(F.struct(pos.alias("pos"), pair["raw"].alias("raw")))).alias("out")
            )

        pairs = F.transform(matches, lambda r, i: F.struct(F.get(between, i).alias("gap"), r.alias("raw")))
        placed = F.aggregate(pairs, start, step, lambda held: held["out"])
        return F.transform(placed, lambda r: F.struct(r["pos"].alias("pos"), make(r["raw"]).alias("date")))

    part = lambda p, i: lambda r: F.regexp_extract(r, p, i)
    dates = F.concat(
        all_of(worded, lambda r: safe_date(part(worded, 3)(r), month_number(part(worded, 2)(r)), part(worded, 1)(r))),
        all_of(numeric, lambda r: safe_date(part(numeric, 3)(r), part(numeric, 2)(r), part(numeric, 1)(r))),
        all_of(iso, lambda r: safe_date(part(iso, 1)(r), part(iso, 2)(r), part(iso, 3)(r))),
    )
    return F.array_sort(F.array_distinct(F.filter(dates, lambda d: d["date"].isNotNull())))


def after_label(text: Column, dates: Column, label: str) -> Column:
    """The first date at or after the end of a label."""
    end = F.regexp_instr(text, F.lit(label)) + F.length(F.regexp_extract(text, label, 0))
    return F.when(text.rlike(label), F.try_element_at(F.filter(dates, lambda d: d["pos"] >= end), F.lit(1))["date"])


def validity(text: Column, until_label: str, from_label: str, first_year: int = 2020) -> Column:
    """struct(from, until): labelled dates, else the earliest and the latest of those recent enough."""
    dates = F.filter(found(text), lambda d: F.year(d["date"]) >= first_year)
    days = F.array_distinct(F.transform(dates, lambda d: d["date"]))
    begin, end = after_label(text, dates, from_label), after_label(text, dates, until_label)
    end = F.coalesce(end, F.when(F.size(days) > 0, F.array_max(days)))
    begin = F.coalesce(begin, F.when((F.size(days) > 1) & (end.isNull() | (F.array_min(days) < end)), F.array_min(days)))
    return ordered(begin, end)


def ordered(begin: Column, end: Column) -> Column:
    """struct(from, until) the right way round."""
    swap = begin > end
    return F.struct(F.when(swap, end).otherwise(begin).alias("from"), F.when(swap, begin).otherwise(end).alias("until"))


def expiry(begin: Column, until: Column, as_of: Column) -> Column:
    """missing, not_yet_valid, expired or valid."""
    return F.when(until.isNull(), "missing").when(begin > as_of, "not_yet_valid").when(until < as_of, "expired").otherwise("valid")


def until_of(start: Column, amount: Column, unit: Column) -> Column:
    """The end of so many days, weeks, months or years (month ends clamp)."""
    u = F.lower(unit)
    return (
        F.when(u.rlike("^(hari|day)"), F.date_add(start, amount))
        .when(u.rlike("^(minggu|week)"), F.date_add(start, amount * 7))
        .when(u.rlike("^(bulan|month)"), F.add_months(start, amount))
        .when(u.rlike("^(tahun|year)"), F.add_months(start, amount * 12))
    )


def display(day: Column) -> Column:
    names = F.array(*(F.lit(m) for m in MONTH_NAMES))
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string"))
