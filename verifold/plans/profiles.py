"""Dimension tables: document profiles with their keywords and aliases, banks and their prefixes.

They are DataFrames built from constants, so any of them can be replaced by a table.  All are a
few hundred rows and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Canonical document types.
PROFILES = (
    "ktp", "kk", "npwp", "pemadanan_npwp", "rekening", "mutasi", "bpjs", "jkn", "iuran", "vaksinasi_1", "vaksinasi_2", "vaksinasi_3",
    "skck", "bpjs_tk", "bpjs_kesanggupan", "ijasah", "transkrip", "formulir_okb", "formulir_lamaran", "surat_lamaran", "foto_profile", "keterangan_kesehatan", "cv",
)
#: Groups of types that gates treat alike.
BANK_PROFILES = ("rekening", "mutasi")
CARD_PROFILES = ("bpjs", "jkn")
IMAGE_ONLY = ("foto_profile",)
#: Words of which any one, for each group, marks a type.
KEYWORDS = {
    "ktp": (("provinsi", "nik", "kewarganegaraan"), ()),
    "kk": (("kartu keluarga", "kepala keluarga"), ()),
    "npwp": (("npwp", "direktorat jenderal pajak"), ()),
    "skck": (("surat keterangan catatan kepolisian",), ()),
    "rekening": (("nomor rekening", "saldo"), ("mutasi",)),
    "mutasi": (("mutasi", "transaksi"), ()),
    "bpjs": (("bpjs kesehatan", "kartu indonesia sehat"), ()),
    "ijasah": (("ijazah", "lulus"), ("transkrip",)),
    "transkrip": (("transkrip", "nilai"), ()),
}

KEYWORD_SCHEMA = "profile string, def_pos int, kind string, group_idx int, kw_pos int, kw string"


def keyword_table(spark: SparkSession, profiles: dict[str, dict] | None = None) -> DataFrame:
    """profiles: name -> {flat: [...], any: [[...], ...], excluded: [...]}; rows of KEYWORD_SCHEMA."""
    if profiles is None:
        profiles = {p: {"flat": list(KEYWORDS.get(p, ((), ()))[0]), "excluded": list(KEYWORDS.get(p, ((), ()))[1])} for p in PROFILES if p in KEYWORDS}
    rows = []
    for n, (name, own) in enumerate(profiles.items()):
        rows += [(name, n, "flat", 0, i, k) for i, k in enumerate(own.get("flat", ()))]
        rows += [(name, n, "any", g, i, k) for g, words in enumerate(own.get("any", ())) for i, k in enumerate(words)]
        rows += [(name, n, "excluded", 0, i, k) for i, k in enumerate(own.get("excluded", ()))]
    return spark.createDataFrame(rows, KEYWORD_SCHEMA)


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    rows = [(a, p) for a, p in (aliases or {p.replace("_", " "): p for p in PROFILES}).items()]
    return spark.createDataFrame(rows, "alias string, profile string")
