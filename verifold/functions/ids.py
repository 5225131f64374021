"""Numbers in documents: identity, card, tax and account numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_only, fold_letters


def runs(text: Column, low: int, high: int) -> Column:
    """Distinct digit runs of that length, standing alone, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![0-9])[0-9]{{{low},{high}}}(?![0-9])"), 0))


def separated(text: Column, *lengths: int) -> Column:
    """Distinct numbers of these lengths whose digits may be parted by spaces, dots or hyphens."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){10,19}(?![0-9])"), 0)
    return F.array_distinct(F.filter(F.transform(found, digits_only), lambda n: F.length(n).isin(*lengths)))


def national_ids(text: Column) -> Column:
    return separated(text, 16)


def tax_ids(text: Column) -> Column:
    return separated(text, 15, 16)


def cards(text: Column) -> Column:
    return runs(text, 16, 16)


def accounts(text: Column) -> Column:
    """Runs of 10-13 digits that are no part of a card number."""
    pans = cards(text)
    return F.filter(runs(text, 10, 13), lambda a: ~F.exists(pans, lambda p: p.contains(a)))


def id16(text: Column) -> Column:
    """The digits if they are 16, else empty."""
    d = digits_only(text)
    return F.when(F.length(d) == 16, d).otherwise("")


def hamming(a: Column, b: Column) -> Column:
    """Differing places; 99 when the lengths differ."""
    places = F.sequence(F.lit(1), F.length(a))
    differ = F.aggregate(places, F.lit(0), lambda n, i: n + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), differ).when((F.length(a) == 0) & (F.length(b) == 0), 0).otherwise(99)


def same_id(found: Column, expected: Column, slack: int = 1) -> Column:
    """Equal after reading letters as digits, but for that many places."""
    return hamming(digits_only(fold_letters(found)), digits_only(expected)) <= slack


def same_tax_id(found: Column, expected: Column) -> Column:
    """Equal, or equal but for a missing first or last digit."""
    f, e = digits_only(found), digits_only(expected)
    return (f == e) | ((F.length(f) == F.length(e) - 1) & e.contains(f) & (F.length(f) >= 14))


def fragment(text: Column, expected: Column, least: int = 11) -> Column:
    """A digit run of at least that length that is part of the expected number."""
    return F.exists(F.regexp_extract_all(text, F.lit(rf"[0-9]{{{least},}}"), 0), lambda r: expected.contains(r))


def card_number(text: Column) -> Column:
    """11-15 digits without leading zeros, else null."""
    d = digits_only(text)
    return F.when(F.length(d).between(11, 15), F.ltrim(d, F.lit("0")))


def birthdate(number: Column) -> Column:
    """ddMMyy in a 16-digit identity number; for women 40 is added to the day."""
    day = F.substr(number, F.lit(7), F.lit(2)).try_cast("int")
    day = F.when(day > 40, day - 40).otherwise(day)
    return F.struct(day.alias("day"), F.substr(number, F.lit(9), F.lit(2)).try_cast("int").alias("month"), F.substr(number, F.lit(11), F.lit(2)).try_cast("int").alias("year"))


def account_method(found: Column, expected: Column) -> Column:
    """How the account numbers agree: exact, leading_zero, one_digit_off, missing_digit, or null."""
    f, e = digits_only(found), digits_only(expected)
    zeros = F.ltrim(f, F.lit("0")) == F.ltrim(e, F.lit("0"))
    dropped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(e), F.lit(1))),
        lambda i: F.concat(F.substr(e, F.lit(1), i - 1), F.substr(e, i + 1, F.length(e))) == f,
    )
    return (
        F.when(F.length(f) == 0, None)
        .when(f == e, "exact")
        .when(zeros, "leading_zero")
        .when(hamming(f, e) == 1, "one_digit_off")
        .when((F.length(f) == F.length(e) - 1) & dropped, "missing_digit")
    )


def spoken_accounts(text: Column) -> Column:
    """Numbers of 10 to 13 digits, also with single separators between digits, that are no part of a card number."""
    number = lambda least, most: F.transform(F.regexp_extract_all(text, F.lit(rf"(?<!\d)\d(?:[\s.-]?\d){{{least},{most}}}(?!\d)"), 0), digits_only)
    pans = number(15, 15)
    return F.array_distinct(F.filter(number(9, 12), lambda a: ~F.exists(pans, lambda p: p.contains(a))))


def family_number(text: Column) -> Column:
    """The number of a family card, 16 digits after ``no``; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?i)no\.?\s*(\d{16})", 1), F.lit(""))


def family_rows(text: Column) -> Column:
    """array of struct(name, nik) of the table rows ``| no | name | number |``."""
    row = F.lit(r"\|\s*\d+\s*\|\s*([^|]+?)\s*\|\s*(\d{16})\s*\|")
    return F.arrays_zip(F.regexp_extract_all(text, row, 1).alias("name"), F.regexp_extract_all(text, row, 2).alias("nik"))


def member_ids(text: Column) -> Column:
    """Members' numbers in order: lines whose digits are 16, else every run of 16; never the family card's own."""
    in_lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), digits_only), lambda d: F.length(d) == 16)
    without = lambda numbers: F.array_distinct(F.array_remove(numbers, F.coalesce(family_number(text), F.lit(""))))
    return F.when(F.size(without(in_lines)) > 0, without(in_lines)).otherwise(without(runs(text, 16, 16)))


def birthdate_in(text: Column, number: Column) -> Column:
    """The birth date an identity number holds, as dd-MM-yyyy, if the text shows it; else null.

    Years of two digits up to 30 are of this century; the number's own year may be of either.
    """
    number = digits_only(number)
    born = birthdate(number)
    pattern = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\b"

    def shown(raw: Column) -> Column:
        y = F.regexp_extract(raw, pattern, 3).cast("int")
        year = F.when(y > 99, y).when(y <= 30, y + 2000).otherwise(y + 1900)
        return F.struct(F.regexp_extract(raw, pattern, 1).cast("int").alias("day"), F.regexp_extract(raw, pattern, 2).cast("int").alias("month"), year.alias("year"))

    def same(d: Column) -> Column:
        return (d["day"] == born["day"]) & (d["month"] == born["month"]) & d["year"].isin(born["year"] + 2000, born["year"] + 1900)

    dates = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), shown), same)
    valid = (F.length(number) == 16) & born["day"].between(1, 31) & born["month"].between(1, 12)
    first = F.get(dates, F.lit(0))
    return F.when(valid & (F.size(dates) > 0), F.format_string("%02d-%02d-%d", first["day"], first["month"], first["year"]))


#: Accounts that forms give as examples.
EXAMPLE_ACCOUNTS = ("1234567890", "1234567891011", "0123456789124", "0123456789")


def account_check(text: Column, expected: Column, most: int = 12) -> Column:
    """struct(account_pass, method, visible, shown) of an expected account against the accounts of a text.

    account_pass is null for fewer than 10 digits; an example account passes if any account is visible;
    the best method of any account counts.
    """
    e, found = digits_only(expected), spoken_accounts(text)
    order = ("exact", "leading_zero", "one_digit_off", "missing_digit")
    methods = F.transform(found, lambda a: account_method(a, e))
    best = F.coalesce(*(F.when(F.array_contains(methods, kind), kind) for kind in order))
    example, visible = e.isin(*EXAMPLE_ACCOUNTS), F.size(found) > 0
    how = F.when(example, F.when(visible, "placeholder_visible_account")).otherwise(best)
    asked = F.length(e) >= 10
    return F.struct(F.when(asked, how.isNotNull()).alias("account_pass"), F.when(asked, how).alias("method"), visible.alias("visible"), F.slice(found, 1, most).alias("shown"))
