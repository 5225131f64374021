"""Decision gates over extractions: column expressions returning whether a document is what it
was asked for and whose it is.

A gate is a table row (``GateSpec``), not a function of its own: which flags say that the
document is of its type, which reject it, whether name, identity number, bank or account count.
Booleans are three-valued: null means that a gate was not evaluated, and only False fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ids
from ..functions.names import holder_match
from . import outcomes


def as_bool(value: Column) -> Column:
    """Text of a JSON value: true, ya, yes, 1 and numbers other than 0 are true."""
    v = F.lower(F.trim(value.cast("string")))
    number = v.try_cast("double")
    return F.coalesce(v.isin("true", "ya", "yes") | F.coalesce(number != 0, F.lit(False)), F.lit(False))


def confidence(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")).try_cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class GateSpec:
    profile: str
    required: tuple[str, ...]  # flags that must hold
    rejecting: tuple[str, ...] = ()  # flags that must not
    use_name: bool = True
    use_id: bool = False
    use_bank: bool = False
    use_account: bool = False
    number: str | None = None  # the extraction's number that is compared with the expected id or account
    marks: tuple[str, ...] = ()  # words in the notes that reject
    cards: tuple[str, ...] = ()  # card numbers, which must agree with one another, with the notes and with the expected one
    other_number: str | None = None  # a second identity number that must agree with the first


#: The gates of all extraction profiles.
GATES = {
    g.profile: g
    for g in (
        GateSpec("ktp", ("is_ktp",), use_id=True, number="nik"),
        GateSpec("npwp", ("is_npwp",), use_name=False, use_id=True, number="npwp_number"),
        GateSpec("pemadanan_npwp", ("is_pemadanan_npwp",), ("is_login",), use_id=True, number="nik"),
        GateSpec("rekening", ("is_front_page",), ("is_transaction_home", "is_product_list", "is_passbook", "is_statement"), use_bank=True, use_account=True, number="account_number"),
        GateSpec("mutasi", ("is_mutation",), use_name=False, use_bank=True, use_account=True, number="account_number"),
        GateSpec("bpjs", ("is_bpjs_kesehatan",), use_id=True, number="nik", cards=("card_number", "info_peserta_card_number"), other_number="info_peserta_nik"),
        GateSpec("jkn", ("is_info_peserta",), ("is_kis_card",), use_id=True, number="bpjs_nik"),
        GateSpec("iuran", ("is_info_iuran",), ("is_payment_history", "has_tagihan"), use_id=True, number="nik"),
        GateSpec("vaksinasi_1", ("is_covid_vaccine", "is_dose_1"), use_id=True, number="nik"),
        GateSpec("vaksinasi_2", ("is_covid_vaccine", "is_dose_2"), use_id=True, number="nik"),
        GateSpec("vaksinasi_3", ("is_covid_vaccine", "is_dose_3"), use_id=True, number="nik"),
        GateSpec("skck", ("is_skck",), use_id=True, number="identity_number"),
        GateSpec("bpjs_tk", ("is_bpjs_tk",), use_id=True, number="nik"),
        GateSpec("bpjs_kesanggupan", ("is_surat_kesanggupan", "has_physical_stamp")),
        *(GateSpec(p, (f"is_{p}",)) for p in ("ijasah", "transkrip", "formulir_okb", "formulir_lamaran", "surat_lamaran")),
        GateSpec("foto_profile", ("is_profile_photo", "is_blue_background"), ("is_wall",), use_name=False),
        GateSpec("keterangan_kesehatan", ("is_health_certificate",), use_id=True, number="identity_number"),
    )
}


def _bare_card(digits: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), digits)


def cards_in(text: Column) -> Column:
    """The distinct runs of 11 to 15 digits, without leading zeros."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"\d+"), 0), lambda d: F.length(d).between(11, 15))
    return F.array_distinct(F.transform(runs, _bare_card))


def card_conflict(numbers: Column, notes: Column, expected: Column) -> Column:
    """Whether the card numbers (array of text) and notes hold two different cards, or a card but the expected one.

    An expected number that isn't one (11 to 15 digits without separators) asks for nothing; one
    that no number answers is a conflict.
    """
    card = lambda c: F.when(F.length(ids.digits_only(c)).between(11, 15), _bare_card(ids.digits_only(c)))
    shown = F.array_compact(F.transform(numbers, card))
    wanted = card(expected)
    foreign = wanted.isNotNull() & ((F.size(shown) == 0) | F.exists(shown, lambda n: n != wanted))
    return (F.size(cards_in(F.concat_ws(" ", numbers, notes))) > 1) | F.coalesce(foreign, F.lit(False))


def identity_pass(name_pass: Column, id_pass: Column, has_name: Column, has_id: Column) -> Column:
    """Either is enough; neither expected is not evaluated."""
    return F.when(F.coalesce(id_pass, F.lit(False)) | F.coalesce(name_pass, F.lit(False)), True).when(has_name | has_id, False)


def decide(rows: DataFrame, spec: GateSpec, bank_prefixes: dict[str, str] | None = None) -> DataFrame:
    """rows: expected_name, expected_nik, expected_card_number, expected_bank, expected_account and the JSON text ``extraction``.

    Adds card_pass (null: the profile has no card), type_pass, name_pass, id_pass, identity_pass, bank_pass, account_method, account_pass,
    document_matched and blockers (in the order card, type, identity, bank, account).
    """
    field = lambda name: F.get_json_object("extraction", f"$.{name}")
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit("")
    has = lambda c: c != ""
    right = F.lit(True)
    for flag in spec.required:
        right = right & as_bool(field(flag))
    for flag in spec.rejecting:
        right = right & ~as_bool(field(flag))
    notes = F.lower(F.coalesce(field("notes"), F.lit("")))
    for mark in spec.marks:
        right = right & ~notes.contains(mark)
    null = F.lit(None).cast("boolean")
    name, number, account = given("expected_name"), ids.id16(given("expected_nik")), ids.digits_only(given("expected_account"))
    shown = F.trim(F.coalesce(field("holder_name"), F.lit("")))
    out = rows.withColumn("type_pass", right)
    if spec.cards:
        shown_cards = F.array(*(F.coalesce(field(c), F.lit("")) for c in spec.cards))
        conflict = card_conflict(shown_cards, F.coalesce(field("notes"), F.lit("")), given("expected_card_number"))
        if spec.other_number:
            own, other = (ids.id16(F.coalesce(field(n), F.lit(""))) for n in (spec.number, spec.other_number))
            conflict = conflict | F.coalesce((own != "") & (other != "") & (own != other), F.lit(False))
        out = out.withColumn("card_pass", ~conflict)
    else:
        out = out.withColumn("card_pass", null)
    if spec.use_name:
        hit = holder_match(shown, name)
        out = out.withColumn("name_pass", F.when(has(name), hit["pass"])).withColumn("name_method", F.when(has(name), hit["method"]))
    else:
        out = out.withColumn("name_pass", null).withColumn("name_method", F.lit(None).cast("string"))
    found = F.coalesce(field(spec.number), F.lit("")) if spec.number else F.lit("")
    out = out.withColumn("id_pass", F.when(has(number), F.coalesce(ids.id16(found) == number, F.lit(False))) if spec.use_id else null)
    wants_id = has(number) if spec.use_id else F.lit(False)
    out = out.withColumn("identity_pass", identity_pass(F.col("name_pass"), F.col("id_pass"), has(name) if spec.use_name else F.lit(False), wants_id))
    if spec.use_account:
        out = out.withColumn("account_method", F.when(F.length(account) >= 10, ids.account_method(found, account)))
        needed = F.lit(True) if spec.profile == "mutasi" else has(account)
        out = out.withColumn("account_pass", F.when(needed, F.col("account_method").isNotNull()))
    else:
        out = out.withColumn("account_method", F.lit(None).cast("string")).withColumn("account_pass", null)
    if spec.use_bank:
        prefix = F.create_map(*(F.lit(x) for p in (bank_prefixes or {"": ""}).items() for x in p))
        by_number = F.try_element_at(prefix, F.left(ids.digits_only(found), F.lit(3)))
        bank = F.coalesce(F.when(F.coalesce(F.col("account_pass"), F.lit(False)), by_number), F.nullif(F.lower(F.trim(field("bank"))), F.lit("")), by_number)
        out = out.withColumn("detected_bank", bank).withColumn("bank_pass", F.coalesce(F.col("detected_bank") == F.lower(given("expected_bank")), F.lit(False)) & has(given("expected_bank")))
    else:
        out = out.withColumn("detected_bank", F.lit(None).cast("string")).withColumn("bank_pass", null)
    failed = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    blockers = F.array(F.when(failed("card_pass"), "CARD_MISMATCH"), F.when(~F.col("type_pass"), "DOCUMENT_TYPE"), F.when(failed("identity_pass"), "IDENTITY"), F.when(failed("bank_pass"), "BANK"), F.when(failed("account_pass"), "ACCOUNT"))
    out = out.withColumn("blockers", F.array_compact(blockers))
    return out.withColumn("document_matched", F.size("blockers") == 0).withColumn("confidence", confidence(field("confidence")))


def members(rows: DataFrame) -> DataFrame:
    """Family or membership lists: the first member whose name or number fits (numbers but for one place).

    rows: doc_id, expected_name, expected_nik, extraction with ``members`` of (name, nik).
    """
    parsed = F.from_json(F.get_json_object("extraction", "$.members"), "array<struct<name string, nik string>>")
    each = rows.select("doc_id", "expected_name", "expected_nik", F.posexplode_outer(parsed).alias("pos", "m"))
    each = each.withColumn("name_hit", F.coalesce(holder_match(F.col("m.name"), F.col("expected_name"))["pass"], F.lit(False)))
    each = each.withColumn("id_hit", F.coalesce(ids.same_id(F.col("m.nik"), F.col("expected_nik")), F.lit(False)))
    hit = F.when(F.col("name_hit") | F.col("id_hit"), F.struct("pos", F.col("m.name").alias("name"), F.col("m.nik").alias("nik")))
    return each.groupBy("doc_id").agg(F.min(hit).alias("member")).withColumn("member_pass", F.col("member").isNotNull())


def validity_gate(rows: DataFrame, text: str, as_of: str, until_label: str, from_label: str) -> DataFrame:
    """A certificate's validity on a given day from its text."""
    v = dates.validity(F.col(text), until_label, from_label)
    state = dates.expiry(v["from"], v["until"], F.lit(as_of).cast("date"))
    return rows.withColumn("valid_from", v["from"]).withColumn("valid_until", v["until"]).withColumn("expiry", state).withColumn("expiry_pass", state == "valid")


def marital_gate(rows: DataFrame, job: str, text: str) -> DataFrame:
    """Helpers must be single; for other jobs the gate isn't evaluated; an unreadable status fails."""
    status = F.lower(F.col(text))
    status = F.regexp_replace(F.regexp_replace(status, r"[0-9]", "i"), r"\s+", " ")
    single = status.rlike(r"belum\s*kawin|belum\s*menikah|\bsingle\b|\blajang\b")
    return rows.withColumn("marital_pass", F.when(F.lower(F.coalesce(F.col(job), F.lit(""))).rlike(r"\bhelper\b"), F.coalesce(single, F.lit(False))))


def error_codes(rows: DataFrame, rules: list[tuple[str, Column]], fallback: str = "generic.validation_failed") -> DataFrame:
    """rules: (code, condition) in order of importance.  Adds error_cases (ordered, distinct) and error_code.

    A matched document has none; one that fails without a known cause has the fallback.
    """
    cases = F.array_distinct(F.array_compact(F.array(*(F.when(condition, code) for code, condition in rules))))
    matched = F.coalesce(F.col("document_matched"), F.lit(False))
    cases = F.when(matched, F.array().cast("array<string>")).when(F.size(cases) == 0, F.array(F.lit(fallback))).otherwise(cases)
    return rows.withColumn("error_cases", cases).withColumn("error_code", F.get("error_cases", F.lit(0)))


#: The order in which failing gates are reported.
STANDARD_RULES = [
    ("policy.marital", lambda: ~F.coalesce(F.col("marital_pass"), F.lit(True))),
    ("policy.expired", lambda: F.col("expiry") == "expired"),
    ("policy.not_yet_valid", lambda: F.col("expiry") == "not_yet_valid"),
    ("document.type", lambda: F.array_contains("blockers", "DOCUMENT_TYPE")),
    ("bank.mismatch", lambda: F.array_contains("blockers", "BANK")),
    ("account.mismatch", lambda: F.array_contains("blockers", "ACCOUNT")),
    ("identity.mismatch", lambda: F.array_contains("blockers", "IDENTITY")),
]


def fallback_merge(rows: DataFrame, least: float = 60.0) -> DataFrame:
    """A second opinion (fallback_type, fallback_identity, fallback_confidence, fallback_profile) rescues
    a failed document if it is confident and of the same profile."""
    sure = (F.col("fallback_confidence") >= least) & F.coalesce(F.col("fallback_profile") == F.col("profile"), F.lit(True))
    rescued = ~F.col("document_matched") & sure & F.coalesce("fallback_type", F.lit(False)) & F.coalesce("fallback_identity", F.lit(True))
    return rows.withColumn("rescued", F.coalesce(rescued, F.lit(False))).withColumn("final_matched", F.col("document_matched") | F.col("rescued"))


def verdict(rows: DataFrame) -> DataFrame:
    """Whose document it is: null where identity was not evaluated or the type is wrong; the status of its ``error_kind`` where rows have one."""
    own = F.when(F.coalesce(F.col("type_pass"), F.lit(False)), F.col("identity_pass"))
    status = F.when(F.col("document_matched").isNotNull(), 200).otherwise(outcomes.http_status(F.col("error_kind")) if "error_kind" in rows.columns else F.lit(500))
    return rows.withColumn("is_own_document", own).withColumn("http_status", status)
