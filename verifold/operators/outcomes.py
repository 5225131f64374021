"""What is reported of validations: status codes, messages, labels, boosts, costs, rows of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T

#: Error kinds of bad requests; kinds that end in ``_unavailable`` are outages, all others faults.
BAD_REQUESTS = ("empty_file", "unknown_document_type", "empty_ocr", "missing_expected_card_number")
#: Document labels of annotations and the profiles they stand for.
LABELS = {
    "ktp": "ktp", "kartu tanda penduduk": "ktp", "kartu tandapenduduk": "ktp", "e-ktp": "ktp", "e ktp": "ktp", "identitas": "ktp",
    "npwp": "npwp", "nomor pokok wajib pajak": "npwp", "kartu keluarga": "kk", "kk": "kk",
    "rekening": "rekening", "rekening koran": "rekening", "rekening tabungan": "rekening",
    "mutasi": "mutasi", "mutasi rekening": "mutasi", "e-statement": "mutasi", "e statement": "mutasi",
    "skck": "skck", "surat keterangan catatan kepolisian": "skck",
}
#: Parts of labels, tried in this order.
LABEL_PARTS = (
    ("ktp|tanda penduduk", "ktp"), ("npwp|wajib pajak", "npwp"), ("kartu keluarga", "kk"),
    ("mutasi|e-statement|e statement", "mutasi"), ("rekening|tabungan", "rekening"), ("skck|kepolisian", "skck"),
)
#: What stands for no name.
NO_NAME = ("", "-", "n/a", "na", "unknown", "not specified", "not applicable", "tidak ada", "tidak diketahui", "tidak tersedia")
#: Phrases of a revenue stamp, in a text and without its spaces.
STAMP = r"(?i)\b(?:e[\s-]?m[ae]t[e]?r[ae][il1]|m[ae]t[e]?r[ae][il1]\s+tempel|bea\s+m[ae]t[e]?r[ae][il1])\b"
STAMP_COMPACT = "m[ea]t[ea]raitempel|beam[ea]t[ea]rai|em[ea]t[ea]rai"
#: Marks of a profile as (pattern on the text without spaces, bonus), with the most they give together.
BOOSTS = {
    "ktp": (0.12, ((r"\d{16}", 0.06), ("nik", 0.04))),
    "npwp": (0.10, (("npwp", 0.04), (r"\d{15,16}", 0.05), ("kantorpelayanan", 0.04), ("pratama", 0.03), ("kpp", 0.03), ("djp", 0.03), ("terdaftar", 0.03))),
    "kk": (0.08, (("kartukeluarga", 0.08),)),
    "mutasi": (0.08, (("e-?statement", 0.08),)),
    "skck": (0.08, (("skck", 0.08),)),
    "bpjs": (0.10, (("kartuindonesiasehat", 0.06), (r"(?<!\d)0\d{12}(?!\d)", 0.04), (r"(?<!\d)\d{16}(?!\d)", 0.04))),
    "bpjs_tk": (0.10, (("kartupeserta", 0.05), ("ketenagakerjaan", 0.05), (r"\d{11}", 0.04))),
    "bpjs_kesanggupan": (0.10, (("suratpernyataankesanggupan", 0.06), ("tidakaktif", 0.04), ("mat[ea]raitempel|met[ea]raitempel", 0.04))),
    "jkn": (0.08, (("infopeserta|namapeserta|statuspeserta|kartuindonesiasehat", 0.08), ("pandawa|faskes", 0.06))),
    "iuran": (0.08, (("infoiuran", 0.08), ("totaltagihan", 0.06))),
}
#: Secondary marks of a field, as patterns on the text or on the text without its spaces.
SIGNALS = {
    "ktp": (r"wni|wna", r"seumurhidup", r"lahir", r"ecamatan", r"keldesa|kel/desa", r"rt/?rw|rt\d|rw\d", r"belumka"),
    "bpjs": (r"nama", r"nik", r"faskes", r"nomorkartu", r"alamat", r"kartuindonesia"),
}
ALL_BOOSTS, ANNOTATED = 0.15, 0.10


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


def http_status(kind: Column) -> Column:
    """200 without an error, 400 for bad requests, 503 for outages, else 500."""
    return F.when(kind.isNull(), 200).when(kind.isin(*BAD_REQUESTS), 400).when(kind.endswith("_unavailable"), 503).otherwise(500)


def label_profile(label: Column) -> Column:
    """The profile of a label: whole, without spaces, by its parts; null for others."""
    spaced = T.normalize(label)
    whole = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    glued = F.create_map(*(F.lit(x) for pair in {k.replace(" ", ""): v for k, v in LABELS.items()}.items() for x in pair))
    parts = [F.when(spaced.rlike(p), profile) for p, profile in LABEL_PARTS]
    return F.coalesce(F.try_element_at(whole, spaced), F.try_element_at(glued, F.replace(spaced, F.lit(" "), F.lit(""))), *parts)


def annotation(raw: Column) -> Column:
    """struct(holder_name, document_type_label) of an annotation's JSON text; null for what is no object; no placeholder names."""
    parsed = F.when(F.trim(raw).startswith("{"), F.from_json(raw, "holder_name string, document_type_label string", {"mode": "PERMISSIVE"}))
    name = F.trim(parsed["holder_name"])
    return F.when(parsed.isNotNull(), F.struct(F.when(~F.lower(name).isin(*NO_NAME), name).alias("holder_name"), parsed["document_type_label"].alias("document_type_label")))


def signals(profile: str, text: Column) -> Column:
    """How many of a profile's secondary marks the text shows."""
    return sum((_bare(text).rlike(p).cast("int") for p in SIGNALS[profile]), F.lit(0))


def boosts(profile: Column, text: Column, label: Column) -> Column:
    """map of the boosts above 0: structural marks up to the profile's cap, a label of the same profile."""
    bare = _bare(text)
    structural = F.lit(0.0)
    for name, (cap, marks) in BOOSTS.items():
        given = sum((F.when(bare.rlike(p), b).otherwise(0.0) for p, b in marks), F.lit(0.0))
        if name in SIGNALS and name == "ktp":
            given = given + F.when(signals(name, text) >= 2, 0.04).otherwise(0.0)
        structural = F.when(profile == name, F.round(F.least(F.lit(cap), given), 4)).otherwise(structural)
    same = F.when(F.coalesce(label_profile(label) == profile, F.lit(False)), ANNOTATED).otherwise(0.0)
    every = F.create_map(F.lit("structural"), structural, F.lit("document_type_label"), same)
    return F.map_filter(every, lambda _, v: v > 0)


def boosted(aggregate: Column, given: Column) -> Column:
    """The aggregate with all its boosts, at most 0.15 more and 1 in all."""
    total = F.aggregate(F.map_values(given), F.lit(0.0), lambda a, b: a + b)
    return F.least(F.lit(1.0), aggregate + F.least(F.lit(ALL_BOOSTS), total))


def has_stamp(text: Column) -> Column:
    """Whether a text names a stuck-on revenue stamp."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(STAMP) | F.regexp_replace(F.lower(t), "[^a-z0-9]+", "").rlike(STAMP_COMPACT)


def portrait_gate(faces: Column, face_area: Column, blue: Column, red: Column, least_area=0.012, most_area=0.75, least_blue=0.32, most_red=0.22) -> Column:
    """struct(face_pass, background_pass, passed) of measured columns: one face of a fitting size before blue, little red.

    A measure that is missing fails its part."""
    face = F.coalesce((faces == 1) & face_area.between(least_area, most_area), F.lit(False))
    back = F.coalesce((blue >= least_blue) & (red <= most_red), F.lit(False))
    return F.struct(face.alias("face_pass"), back.alias("background_pass"), (face & back).alias("passed"))


def stamp_gate(has_image: Column, stamps_seen: Column, text: Column) -> Column:
    """With an image a measured stamp must be there; without one the text must name it."""
    return F.when(F.coalesce(has_image, F.lit(False)), F.coalesce(stamps_seen > 0, F.lit(False))).otherwise(has_stamp(text))


def page_cost(pages: Column, rate: Column, exchange: Column) -> Column:
    """struct(usd, local) of so many pages at a price per thousand, in decimals."""
    usd = (pages.cast("decimal(18,0)") * rate.cast("decimal(10,4)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(24,7)")
    return F.struct(usd.alias("usd"), (usd * exchange.cast("decimal(12,2)")).cast("decimal(30,4)").alias("local"))


def with_messages(rows: DataFrame, catalogue: DataFrame, fallback: str = "generic.validation_failed") -> DataFrame:
    """rows with error_code, profile; catalogue(code, message).  Adds error_message.

    Unknown codes ending in name_mismatch, wrong_document and nik_mismatch have a message of their
    kind, any other has the fallback's.  A null code has none.  The catalogue is met in a join that
    Spark broadcasts by its size.
    """
    plain = catalogue.where(F.col("code") == fallback).select(F.col("message").alias("_other"))
    out = rows.join(catalogue.select(F.col("code").alias("error_code"), F.col("message").alias("_own")), "error_code", "left").join(plain, F.lit(True), "left")
    title = F.upper(F.coalesce(F.col("profile"), F.lit("dokumen")))
    kinds = (
        F.when(F.col("error_code").endswith(".name_mismatch"), F.concat(F.lit("Nama pada "), title, F.lit(" tidak cocok.")))
        .when(F.col("error_code").endswith(".wrong_document"), F.concat(F.lit("Dokumen ini bukan "), title, F.lit(" yang valid.")))
        .when(F.col("error_code").endswith(".nik_mismatch"), F.lit("NIK/nomor NPWP 16 digit tidak cocok."))
    )
    message = F.when(F.col("error_code").isNotNull(), F.coalesce(F.col("_own"), kinds, F.col("_other")))
    return out.withColumn("error_message", message).drop("_own", "_other")


def catalogue_by_document(catalogue: DataFrame) -> DataFrame:
    """document, codes: the codes before the first dot, each with its sorted codes (bounded by the catalogue)."""
    return catalogue.groupBy(F.substring_index("code", ".", 1).alias("document")).agg(F.array_sort(F.collect_list("code")).alias("codes"))


def fallback_counts(results: DataFrame, *by: str) -> DataFrame:
    """attempted, succeeded and rescued second opinions of results(fallback_ok, matched, rescued)."""
    return results.groupBy(*by).agg(
        F.count_if(F.col("fallback_ok").isNotNull()).alias("attempted"), F.count_if(F.col("fallback_ok")).alias("succeeded"), F.count_if(F.col("rescued")).alias("rescued")
    )


def failures(results: DataFrame) -> DataFrame:
    """The rows that failed, as a table of their own: errors first named as such, then documents that don't match."""
    kind = F.when(~F.col("ok"), "pipeline_error").when(~F.col("matched"), "validation_fail")
    return results.withColumn("failure", kind).where("failure IS NOT NULL")


def with_blocker(blockers: Column, blocker: str, condition: Column) -> Column:
    """The blocker in front, where the condition holds and it isn't there."""
    return F.when(F.coalesce(condition, F.lit(False)) & ~F.array_contains(blockers, blocker), F.concat(F.array(F.lit(blocker)), blockers)).otherwise(blockers)


#: Order of the gates after the decision, as (blocker, column that is false where the gate fails).
CHAIN = (("MARITAL_STATUS", "marital_pass"), ("EXPIRED", "expiry_pass"), ("STAMP", "stamp_pass"), ("HEALTH", "health_pass"))


def chain(rows: DataFrame) -> DataFrame:
    """Applies the gates that rows have in their fixed order; null is not evaluated and doesn't fail.  A later blocker stands before earlier ones."""
    out = rows
    for blocker, gate in CHAIN:
        if gate in rows.columns:
            out = out.withColumn("blockers", with_blocker(F.col("blockers"), blocker, ~F.col(gate)))
    return out.withColumn("document_matched", F.col("document_matched") & (F.size("blockers") == 0))


def summary(dimensions: list[tuple[str, Column, Column]]) -> Column:
    """One line of (title, passed, percent): ticks and percentages; a null pass wasn't checked."""
    mark = lambda t, p, n: F.when(p.isNull(), f"{t} tidak dicek").otherwise(F.concat(F.lit(f"{t} "), F.when(p, "✓").otherwise("✗"), F.lit(" ("), n.cast("string"), F.lit("%)")))
    return F.concat_ws(" · ", *(mark(*d) for d in dimensions))


#: Fields of a validation that a log keeps, in this order.
LOGGED = ("document_matched", "type_pass", "identity_pass", "bank_pass", "account_pass", "card_pass", "confidence", "error_code", "blockers")


def log_row(rows: DataFrame, *keys: str, most_keywords: int = 40) -> DataFrame:
    """keys and the logged fields that rows have, lists of keywords cut to their first 40."""
    kept = [c for c in LOGGED if c in rows.columns]
    lists = [F.slice("keywords", 1, most_keywords).alias("keywords")] if "keywords" in rows.columns else []
    return rows.select(*keys, *kept, *lists)


def compare_names(docs: DataFrame, text: str, expected: str, *keys: str, threshold: float = 85.0) -> DataFrame:
    """keys, candidate, score, matched: the whole text and, where it is long, its name-like segments and runs of two to four words against one name.

    The best score counts, ties go to the earlier candidate.  A text or name without words: no candidate, 0, false.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    long = (F.size(T.tokens(t)) > 6) | t.contains("\n")
    parts = F.filter(T.segments(t), T.looks_like_name)
    wide = F.flatten(F.transform(T.segments(t), T.refined_names))
    tried = F.array_distinct(F.concat(F.array(t), F.when(long, F.concat(parts, wide, T.windows(T.tokens(t), 2, 3, 4))).otherwise(F.array().cast("array<string>"))))
    each = docs.select(*keys, F.col(expected).alias("_name"), F.posexplode(tried).alias("_pos", "candidate"))
    each = each.withColumn("_s", names.identity(F.col("candidate"), F.col("_name")))
    best = each.groupBy(*keys).agg(F.max(F.struct(F.col("_s.score").alias("score"), (-F.col("_pos")).alias("before"), F.col("candidate"), F.col("_s.gate").alias("gate"))).alias("b"))
    found = F.col("b.score") > 0
    return best.select(*keys, F.when(found, F.col("b.candidate")).alias("candidate"), F.col("b.score").alias("score"), ((F.col("b.score") >= threshold) & F.col("b.gate")).alias("matched"))


#: Anchors that prove a document's type although its keywords don't: (profile, name, condition on text and passes).
ANCHORS = (
    (("npwp", "pemadanan_npwp"), "npwp_tax_id_anchor", lambda t, own, bank, account: _bare(t).contains("npwp") & _bare(t).rlike(r"\d{15,16}")),
    (("ktp",), "ktp_nik_anchor", lambda t, own, bank, account: _bare(t).rlike(r"\d{16}") & ((signals("ktp", t) >= 3) | ((signals("ktp", t) >= 2) & own))),
    (("bpjs",), "bpjs_identity_field_anchor", lambda t, own, bank, account: own & (signals("bpjs", t) >= 2)),
    (("jkn",), "jkn_kis_or_info_anchor", lambda t, own, bank, account: own & _bare(t).rlike("kartuindonesiasehat|infopeserta|namapeserta")),
    (("rekening",), "rekening_identity_account_anchor", lambda t, own, bank, account: bank & (own | account)),
    (("mutasi",), "mutasi_account_anchor", lambda t, own, bank, account: bank & account),
)


def rescue_type(rows: DataFrame, text: str = "text", least: float = 0.7) -> DataFrame:
    """rows(profile, exclusion, type_pass, identity_pass, bank_pass, account_pass, aggregate, type_ratio, boosts) with the types that anchors prove.

    A rescued row passes, has at least the required ratio, and a boost of the anchor's name by what its
    aggregate lacked.  Exclusions are never rescued; null passes count as not passed; others stay as they are.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    hits = [F.when(F.col("profile").isin(*p) & F.coalesce(fits(F.col(text), said("identity_pass"), said("bank_pass"), said("account_pass")), F.lit(False)), name) for p, name, fits in ANCHORS]
    out = rows.withColumn("_anchor", F.when(~said("exclusion") & ~said("type_pass"), F.coalesce(*hits)))
    rescued = F.col("_anchor").isNotNull()
    lacked = F.round(F.greatest(F.lit(0.0), least - F.col("aggregate")), 4)
    out = out.withColumn("boosts", F.when(rescued, F.map_concat("boosts", F.create_map(F.coalesce("_anchor", F.lit("")), lacked))).otherwise(F.col("boosts")))
    out = out.withColumn("type_ratio", F.when(rescued, F.greatest(F.col("type_ratio"), F.lit(least))).otherwise(F.col("type_ratio")))
    return out.withColumn("type_pass", F.when(rescued, True).otherwise(F.col("type_pass"))).drop("_anchor")
