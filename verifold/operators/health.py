"""Health letters: damaged text repaired, its dates read, the day of the check chosen, the conclusion judged."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.functions import pandas_udf

from ..functions import dates
from ..functions.fuzzy import struct_of

#: Misread month names.
MISREAD = {
    "besember": "desember", "funi": "juni", "suni": "juni", "jomi": "juni", "juai": "juni", "juri": "juni", "jumi": "juni", "junl": "juni", "jusi": "juni",
    "we!": "mei", "mel": "mei", "mer": "mei", "wei": "mei",
}
#: Repairs of damaged years and days in this order, on lower-cased text.
REPAIRS = (
    (r"\b(\d{2})(\d{2})\s+20\s+(\d{2})\b", "$1/$2/20$3"),
    (r"(?<!\d)20[.\s]{2,}(\d)\b", "202$1"),
    (r"\b20[\s.]+([2-3]\d)\b", "20$1"),
    (r"\b20[.\s]*([2-3])[.\s]+(\d)\b", "20$1$2"),
    (r"\.{2,}(20\d{0,2})\b", " $1"),
    (r"\b(\d{1,2})\s+106\s+\d?\s*(20[2-3]\d)\b", "$1 06 $2"),
    (r"\b2[oa]([6-9])\b", "202$1"),
    (r"(\d{1,2}\s*[/-]\s*\d{1,2}\s+)1(20[2-3]\d)\b", "$1$2"),
    (r"(\d{1,2})[/-]0/+?(20[2-3]\d)", "$1/06/$2"),
    (r"\bo(\d)\b", "0$1"),
    (r"(?:,\s*)?\b(?:[01]?\d|2[0-3])[.:][0-5]\d\b(?![/.-]?\d)", " "),
)
#: Conclusions, choices printed on forms, labels, signatures, noise.
NEGATIVE = r"(?i)tidak\s+sehat|kurang\s+sehat|dinyatakan\s+sakit|\bunfit\b|tidak\s+fit"
POSITIVE = r"(?i)\bsehat\b|fit\s+to\s+work|fit\s+for\s+work|surat\s+keterangan\s+dokter|kesehatan\s+badan"
CHOICE = r"(?i)seha[t]?\s*/\s*tidak\s*sehat|tidak\s+sehat\s*/\s*seha[t]?"
UNTIL = r"sampai\s+dengan|yaitu\s+sampai|valid\s+until|until|berlaku\s+(?:hingga|sampai)(?!\s+selama)"
BORN = r"lahir|\bttl\b|tempat\s+dan\s+tgl"
SIGNED = r"demikian\s+surat|dokter|yang\s+memeriksa|tgl\.?\s*cetak|dikeluarkan|terverifikasi"
NOISE = r"\bsip\b|dpm[-\s]?ptsp|/du/\d{4}|izin\s+nomor|nip\s*:|\bvisus\b|\bods?\b"
LASTS = r"(?i)(?:berlaku|masa\s+berlaku)[^\d]{0,52}(\d+)\s*(?:\([^)]{0,24}\)\s*)?(hari|bulan|minggu)"
WORDED = "|".join(sorted(dates.MONTH_NUMBER, key=len, reverse=True))
#: How dates are written: pattern with the groups d, m or name, y.  Earlier patterns take their characters first.
WRITTEN = tuple(
    re.compile(p)
    for p in (
        rf"\b(?P<d>\d{{1,2}})[\s./-]*(?P<name>{WORDED})[\s.,/-]*(?P<y>20\d{{2}}|\d{{2}}|2\d{{2}})\b",
        rf"\b(?P<name>{WORDED})\s+(?P<d>\d{{1,2}})(?!\d)[\s.,]+(?P<y>20\d{{2}}|\d{{2}})\b",
        r"(?<![\d/])(?P<y>20\d{2})[/-](?P<m>\d{1,2})[/-](?P<d>\d{1,2})(?![\d/])",
        r"\b(?P<d>\d{1,2})\s*[/.-]\s*(?P<m>\d{1,2})\s*[/. -]\s*(?P<y>20\d{2}|\d{2}|2\d{2})\b",
        r"(?<!\d)(?P<y>20[2-3]\d)(?P<m>0[1-9]|1[0-2])(?P<d>0[1-9]|[12]\d|3[01])(?!\d)",
        r"(?<!\d)(?P<d>0[1-9]|[12]\d|3[01])(?P<m>0[1-9]|1[0-2])(?P<y>20[2-3]\d)(?!\d)",
        r"\b(?P<d>\d{1,2})\s+(?P<m>0?[1-9]|1[0-2])\s+(?P<y>20\d{2})\b",
    )
)


def repaired(text: Column) -> Column:
    """Lower-cased, with damaged years, days and months mended and times of day left out."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for wrong, right in REPAIRS:
        t = F.regexp_replace(t, wrong, right)
    for wrong, right in MISREAD.items():
        t = F.regexp_replace(t, rf"(?<![a-z]){wrong}(?![a-z])", right)
    t = F.regexp_replace(t, rf"(?<=\d)({WORDED})", " $1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mended_day(day: Column) -> Column:
    """66 is 06: tens of 6, 8 and 9 beyond a month's days are a misread 0."""
    return F.when(day.between(1, 31), day).when(F.floor(day / 10).isin(6, 8, 9) & (day <= 99) & (day % 10 > 0), day % 10).cast("int")


def mended_year(raw: Column, first: int = 2024, last: int = 2035) -> Column:
    """A year of damaged characters, if it is in the window: whole, of two digits, or of three (226 is 2026)."""
    n = F.regexp_replace(F.translate(F.lower(raw), "oc", "06"), r"\D", "").try_cast("int")
    tries = (n, n + 2000, n + 1800)
    return F.coalesce(*(F.when(t.between(first, last), t) for t in tries))


def day_of(match: re.Match, window: tuple[int, int]) -> date | None:
    part = match.groupdict()
    month = dates.MONTH_NUMBER[part["name"]] if part.get("name") else int(part["m"])
    day, raw = int(part["d"]), int(part["y"])
    if 31 < day <= 99 and day // 10 in (6, 8, 9):
        day %= 10
    year = next((y for y in (raw, raw + 2000, raw + 1800) if window[0] <= y <= window[1]), None)
    try:
        return date(year, month, day) if year else None
    except ValueError:
        return None


def read(text: str, window: tuple[int, int]) -> list[tuple[int, int, date, bool]]:
    """(start, end, day, by name) of the dates in a mended text; no character belongs to two of them."""
    taken: list[tuple[int, int]] = []
    out = []
    for pattern in WRITTEN:
        for m in pattern.finditer(text):
            if any(m.start() < e and s < m.end() for s, e in taken):
                continue
            day = day_of(m, window)
            if day:
                taken.append(m.span())
                out.append((*m.span(), day, bool(m.groupdict().get("name"))))
    return sorted(out)


def choose(text: str, window: tuple[int, int]) -> tuple[date | None, date | None, list[date]]:
    """(check, until, all): the date behind an until label; of the others, neither births nor licences,
    the last by name near a signature, by name, near a signature, at all."""
    found = read(text, window)
    until, used = None, set()
    for label in re.finditer(UNTIL, text):
        hit = next((f for f in found if label.end() <= f[0] <= label.end() + 90), None)
        if hit:
            used.add(hit[0])
            until = until or hit[2]

    def usable(f) -> bool:
        before, around = text[max(0, f[0] - 48) : f[0]], text[max(0, f[0] - 28) : f[1] + 36]
        return f[0] not in used and not re.search(BORN, before) and (f[3] or not re.search(NOISE, around))

    def signed(f) -> bool:
        return bool(re.search(SIGNED, text[max(0, f[0] - 96) : f[0]])) or f[0] >= 0.48 * len(text)

    good = [f for f in found if usable(f)]
    for wanted in (lambda f: f[3] and signed(f), lambda f: f[3], signed, lambda f: True):
        hits = [f for f in good if wanted(f)]
        if hits:
            return hits[-1][2], until, sorted({f[2] for f in found})
    return None, until, sorted({f[2] for f in found})


def letter_dates(first: int = 2024, last: int = 2035):
    """A vectorised UDF of a mended text: struct(checked, until, found)."""

    @pandas_udf(struct_of(checked=Ty.DateType(), until=Ty.DateType(), found=Ty.ArrayType(Ty.DateType())))
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([choose(t or "", (first, last)) for t in text], columns=["checked", "until", "found"], dtype=object)

    return of


def healthy(text: Column) -> Column:
    """Whether a letter says so: a positive word or a printed choice, and no negative one outside of choices.  Null: false."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(t, CHOICE, " ")
    return (bare.rlike(POSITIVE) | t.rlike(CHOICE)) & ~bare.rlike(NEGATIVE)


def lasts_until(text: Column, checked: Column) -> Column:
    """The day until which a letter says that it holds for so many days, weeks or months; null without that."""
    amount = F.greatest(F.lit(1), F.nullif(F.regexp_extract(text, LASTS, 1), F.lit("")).try_cast("int"))
    return dates.until_of(checked, F.when(F.regexp_extract(text, LASTS, 1) != "", amount), F.regexp_extract(text, LASTS, 2))


def gate(letters: DataFrame, text: str, first: int = 2024, last: int = 2035) -> DataFrame:
    """Adds health_pass, expiry_pass (always true: dates never fail a letter), checked_on, valid_until, dates_found."""
    d = letter_dates(first, last)(repaired(F.col(text)))
    out = letters.withColumn("health_pass", healthy(F.col(text))).withColumn("expiry_pass", F.lit(True)).withColumn("_d", d)
    until = F.coalesce(F.col("_d.until"), lasts_until(F.lower(F.coalesce(F.col(text), F.lit(""))), F.col("_d.checked")))
    return out.withColumn("checked_on", F.col("_d.checked")).withColumn("valid_until", until).withColumn("dates_found", F.col("_d.found")).drop("_d")


def iso_day(value: Column) -> Column:
    """The day of a text that begins with yyyy-MM-dd; null for others and for days that aren't."""
    return F.when(F.trim(value).rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(F.left(F.trim(value), F.lit(10)), F.lit("yyyy-MM-dd"))))


def resolved_validity(from_text: Column, until_text: Column, notes: Column, from_iso: Column, until_iso: Column) -> Column:
    """struct(from, until): the date written beside each label, else the labelled one of the notes, else the given ISO day; the right way round."""
    first = lambda t: F.get(dates.found(F.coalesce(t, F.lit(""))), F.lit(0))["date"]
    said = dates.validity(F.coalesce(notes, F.lit("")), r"(?i)sampai dengan", r"(?i)berlaku dari")
    return dates.ordered(F.coalesce(first(from_text), said["from"], iso_day(from_iso)), F.coalesce(first(until_text), said["until"], iso_day(until_iso)))
