"""Banks of account documents: aliases, signals, decision, and which arguments a profile asks for."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.functions import pandas_udf

from ..functions import fuzzy, ids
from ..functions import text as T

#: What users call the banks.
ALIASES = {
    "mandiri": "mandiri", "bank mandiri": "mandiri", "livin": "mandiri", "livin by mandiri": "mandiri",
    "mas": "mas", "bank mas": "mas", "bank mas saving": "mas", "multi arta sentosa": "mas",
}


@dataclass(frozen=True)
class Bank:
    name: str
    phrases: tuple[str, ...]
    prefixes: tuple[str, ...]  # of account numbers
    digits: int  # of an account number
    words: str  # pattern of the bank's own words in their context
    word_score: float
    context: tuple[str, ...] = ()  # one of these must stand beside the words
    not_with: tuple[str, ...] = ()  # none of these may
    counterparty: str = ""  # phrases of transfers, where the bank is only the other side
    products: str = ""  # words that prove its account although another bank's account is there


#: Phrases, account prefixes and contexts of the banks.
BANKS = (
    Bank(
        "mandiri",
        ("livin by mandiri", "livin", "bank mandiri", "detail rekening", "sebagai rekening utama", "tabungan now", "tabungan payroll", "daftar kartu"),
        ("006", "012", "070", "114", "115", "117", "120", "121", "125", "126", "129", "132", "133", "134", "136", "138", "139", "156", "157", "163", "166", "167", "173", "177", "180", "182", "184", "185", "187", "603"),
        13,
        r"\bmandiri\b",
        88.0,
        context=("rekening", "tabungan", "livin", "detail", "saving", "saldo", "transfer", "rekeningku"),
        not_with=("peserta mandiri", "binakarya mandiri", "kemandirian"),
    ),
    Bank(
        "mas",
        ("bank mas", "mas saving", "bebaspoin", "bebas poin", "multi arta sentosa"),
        ("100", "120"),
        10,
        r"\bmas saving\b|\bbank mas\b",
        92.0,
        counterparty=r"\b(?:dari|ke)\s+bank mas\b",
        products=r"\bmas saving\b|bebaspoin|bebas poin",
    ),
)
PHRASE, ACCOUNT, LEAST, GAP = 82.0, 96.0, 70.0, 8.0


def normalize(bank: Column) -> Column:
    """The bank that an alias names; null for unknown ones."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.try_element_at(table, T.normalize(bank))


@pandas_udf(Ty.DoubleType())
def phrase_score(norm: pd.Series, phrases: pd.Series) -> pd.Series:
    """The best score of the phrases: 100 where one stands in the text, else its partial ratio."""
    known: dict[tuple[str, str], float] = {}

    def one(text: str, phrase: str) -> float:
        if phrase in text:
            return 100.0
        key = (text, phrase)
        if key not in known:
            known[key] = fuzzy.partial_ratio(phrase, text)
        return known[key]

    return pd.Series([max((one(t or "", p) for p in ps), default=0.0) for t, ps in zip(norm, phrases, strict=True)], dtype=float)


def own_accounts(bank: Bank, numbers: Column) -> Column:
    """The numbers of a bank's length and prefixes; long ones may have lost a leading zero."""

    def whole(n: Column) -> Column:
        fits = F.when(F.length(n) == bank.digits, n)
        return fits.when(F.length(n) == bank.digits - 1, F.concat(F.lit("0"), n)) if bank.digits > 12 else fits

    return F.filter(F.transform(numbers, whole), lambda n: F.left(n, F.lit(3)).isin(*bank.prefixes))


def scores(docs: DataFrame, text: str, fuzzily: bool = True) -> DataFrame:
    """Adds <bank>_score and <bank>_accounts for each bank.

    ``fuzzily`` False takes phrases only where they stand word for word, without Python.
    Accounts of a bank without the marks of its products are the other side's if another bank's account is there.
    """
    norm = T.normalize(F.coalesce(F.col(text), F.lit("")))
    numbers = ids.spoken_accounts(F.coalesce(F.col(text), F.lit("")))
    out = docs.withColumn("_norm", norm).withColumn("_numbers", numbers)
    for bank in BANKS:
        own = own_accounts(bank, F.col("_numbers"))
        out = out.withColumn(f"{bank.name}_accounts", own)
    for bank in BANKS:
        norm = F.col("_norm")
        bare = F.regexp_replace(norm, bank.counterparty, " ") if bank.counterparty else norm
        others = [F.size(f"{b.name}_accounts") > 0 for b in BANKS if b is not bank]
        spoken = bare.rlike(bank.words)
        if bank.context:
            spoken = spoken & norm.rlike("|".join(bank.context))
        if bank.not_with:
            spoken = spoken & ~norm.rlike("|".join(bank.not_with))
        allowed = F.array(*(F.lit(p) for p in bank.phrases))
        if bank.counterparty:
            clash = norm.rlike(bank.counterparty) | norm.rlike(r"\bbank mandiri\b")
            allowed = F.when(clash, F.array_remove(allowed, bank.phrases[0])).otherwise(allowed)
        said = phrase_score(norm, allowed) if fuzzily else F.when(F.exists(allowed, lambda p: norm.contains(p)), 100.0).otherwise(0.0)
        counts = F.size(f"{bank.name}_accounts") > 0
        if bank.products:
            for other in others:
                counts = counts & (norm.rlike(bank.products) | ~other)
        score = F.greatest(F.when(said >= PHRASE, said).otherwise(0.0), F.when(spoken, bank.word_score).otherwise(0.0), F.when(counts, ACCOUNT).otherwise(0.0))
        out = out.withColumn(f"{bank.name}_score", F.round(score, 2))
    return out.drop("_norm", "_numbers")


def decide(least: float = LEAST, gap: float = GAP) -> Column:
    """The leading bank of <bank>_score: null below ``least``, at a tie, or if a second one over ``least`` is within ``gap``."""
    ranked = F.sort_array(F.array(*(F.struct(F.col(f"{b.name}_score").alias("score"), F.lit(b.name).alias("bank")) for b in BANKS)), asc=False)
    first, second = ranked[0], ranked[1]
    close = (second["score"] >= least) & (first["score"] - second["score"] < gap)
    return F.when((first["score"] >= least) & ~close & (first["score"] > second["score"]), first["bank"])


#: Which arguments a profile must be given: each row is (profiles, condition on the row's columns, error kind).
ARGUMENTS = (
    (("bpjs", "jkn"), lambda c: F.length(ids.digits_only(c("expected_card_number"))).between(11, 15), "missing_expected_card_number"),
    (("rekening", "mutasi"), lambda c: normalize(c("expected_bank")).isNotNull(), "missing_expected_bank"),
    (("rekening",), lambda c: (F.trim(c("expected_name")) != "") | (F.length(ids.digits_only(c("expected_account"))) >= 10), "missing_expected_identity"),
    (("mutasi",), lambda c: F.length(ids.digits_only(c("expected_account"))) >= 10, "missing_expected_account"),
)


def argument_error(rows: DataFrame) -> Column:
    """The first argument that the row's ``profile`` asks for and doesn't have, as an error kind; null when none is missing."""
    given = lambda name: F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")
    return F.coalesce(*(F.when(F.col("profile").isin(*profiles) & ~F.coalesce(fits(given), F.lit(False)), kind) for profiles, fits, kind in ARGUMENTS))
