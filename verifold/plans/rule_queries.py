"""Registered queries of banks, members, outcomes and health letters over texts made of the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import banks, health, outcomes, participants
from .queries import query, table


def number(n: int):
    return F.lpad(F.col("c_custkey").cast("string"), n, "0")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'mandiri' WHEN 1 THEN 'mandiri' WHEN 2 THEN 'mas' END AS bank FROM customer""")
def bank_normalized(spark, d):
    said = F.element_at(F.array(*(F.lit(x) for x in (" Livin  by MANDIRI ", "bank mandiri", "Multi Arta Sentosa", "bca"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", banks.normalize(said).alias("bank"))


def bank_texts(spark, d):
    """Six kinds of screens: phrases, accounts with separators, transfers to the other bank, words in and out of context, neither."""
    c = table(spark, d, "customer")
    kinds = F.array(
        F.concat(F.lit("Detail Rekening\nTabungan 125"), number(10)),
        F.concat(F.lit("MAS Saving 100"), number(7)),
        F.concat(F.lit("transfer ke bank mas 100"), number(7), F.lit(" dari 125 "), number(10)),
        F.lit("Mandiri saldo"),
        F.lit("peserta mandiri saldo"),
        F.concat(F.lit("1250"), number(12)),
    )
    return c.select("c_custkey", F.element_at(kinds, (F.col("c_custkey") % 6 + 1).cast("int")).alias("text"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 100.0 WHEN 2 THEN 96.0 WHEN 3 THEN 88.0 ELSE 0.0 END AS mandiri_score, CASE c_custkey % 6 WHEN 1 THEN 100.0 ELSE 0.0 END AS mas_score,
 CASE c_custkey % 6 WHEN 0 THEN 'mandiri' WHEN 1 THEN 'mas' WHEN 2 THEN 'mandiri' WHEN 3 THEN 'mandiri' END AS bank FROM customer""")
def bank_decision(spark, d):
    return banks.scores(bank_texts(spark, d), "text", fuzzily=False).withColumn("bank", banks.decide()).select("c_custkey", "mandiri_score", "mas_score", "bank")


@query()
def bank_decision_fuzzy(spark, d):
    return banks.scores(bank_texts(spark, d), "text").withColumn("bank", banks.decide()).select("c_custkey", "mandiri_score", "mas_score", "bank")


@query(f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS account_pass,
 CASE c_custkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'one_digit_off' WHEN 2 THEN 'missing_digit' END AS method, (c_custkey % 4 <> 3) AS visible FROM customer""")
def account_in_text(spark, d):
    """Each account shown whole with spaces, with a digit misread, with one missing, and only as part of a card number."""
    own = F.concat(F.lit("987"), number(10))
    kinds = F.array(
        F.concat(F.lit("rek 987 "), number(10)), F.concat(F.lit("rek 986"), number(10)), F.concat(F.lit("rek 97"), number(10)), F.concat(F.lit("kartu 555"), own)
    )
    c = table(spark, d, "customer").withColumn("a", ids.account_check(F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")), own))
    return c.select("c_custkey", "a.account_pass", "a.method", "a.visible")


ARGUMENT_KINDS = ("bpjs", "jkn", "rekening", "mutasi", "ktp")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_custkey % 3 <> 0 THEN 'missing_expected_card_number' END WHEN 1 THEN CASE WHEN o_custkey % 3 <> 0 THEN 'missing_expected_card_number' END
 WHEN 2 THEN CASE WHEN o_custkey % 2 <> 0 THEN 'missing_expected_bank' END WHEN 3 THEN CASE WHEN o_custkey % 2 <> 0 THEN 'missing_expected_bank' WHEN o_custkey % 3 <> 0 THEN 'missing_expected_account' END END AS error_kind FROM orders""")
def argument_gates(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.element_at(F.array(*(F.lit(k) for k in ARGUMENT_KINDS)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("profile"),
        F.when(F.col("o_custkey") % 3 == 0, "000-1234-5678-90").alias("expected_card_number"),
        F.when(F.col("o_custkey") % 2 == 0, "Livin").alias("expected_bank"),
        F.lit("Budi").alias("expected_name"),
        F.when(F.col("o_custkey") % 3 == 0, "1250012345678").otherwise("12").alias("expected_account"),
    )
    return rows.select("o_orderkey", banks.argument_error(rows).alias("error_kind"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN CASE user_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 503 ELSE 500 END ELSE 200 END AS http_status FROM events""")
def http_status_by_kind(spark, d):
    e = table(spark, d, "events")
    kind = F.element_at(F.array(F.lit("empty_file"), F.lit("ktp_ai_unavailable"), F.lit("crash")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select("event_id", outcomes.http_status(F.when(F.col("event_type") == "error", kind)).alias("http_status"))


LABELS = ("Kartu  Tanda Penduduk", "KARTUKELUARGA", "e - statement bulanan", "surat wajib pajak", "Mutasi tabungan", "buku tabungan", "ijazah", "")


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'ktp' WHEN 1 THEN 'kk' WHEN 3 THEN 'npwp' WHEN 4 THEN 'mutasi' WHEN 5 THEN 'rekening' END AS profile FROM customer""")
def annotation_profiles(spark, d):
    said = F.element_at(F.array(*(F.lit(x) for x in LABELS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    raw = F.to_json(F.struct(F.col("c_name").alias("holder_name"), said.alias("document_type_label")))
    return table(spark, d, "customer").select("c_custkey", outcomes.label_profile(outcomes.annotation(raw)["document_type_label"]).alias("profile"))


@query(r"""SELECT doc_id, CASE WHEN b.structural > 0 OR b.label > 0 THEN least(1.0, 0.5 + least(0.15, b.structural + b.label)) ELSE 0.5 END AS boosted FROM (
 SELECT doc_id, {'structural': least(0.08, CASE WHEN regexp_replace(lower(text), '\s+', '', 'g') LIKE '%infopeserta%' OR regexp_replace(lower(text), '\s+', '', 'g') LIKE '%kartuindonesiasehat%' THEN 0.08 ELSE 0.0 END
 + CASE WHEN regexp_matches(regexp_replace(lower(text), '\s+', '', 'g'), 'pandawa|faskes') THEN 0.06 ELSE 0.0 END), 'label': 0.0} AS b
 FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' INFO  Peserta ' WHEN 1 THEN ' faskes ' ELSE '' END AS text FROM documents))""")
def structural_boosts(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, " INFO  Peserta ").when(F.col("doc_id") % 3 == 1, " faskes ").otherwise("")
    docs = table(spark, d, "documents").withColumn("text", F.concat("text", tail))
    return docs.select("doc_id", outcomes.boosted(F.lit(0.5), outcomes.boosts(F.lit("jkn"), F.col("text"), F.lit("x"))).alias("boosted"))


@query("""SELECT p_partkey, round(p_size * 2 / 1000, 7)::DOUBLE AS usd, round(p_size * 2 / 1000 * 17000, 4)::DOUBLE AS local FROM part""")
def page_costs(spark, d):
    p = table(spark, d, "part").withColumn("c", outcomes.page_cost(F.col("p_size"), F.lit("2"), F.lit("17000")))
    return p.select("p_partkey", F.col("c.usd").cast("double").alias("usd"), F.col("c.local").cast("double").alias("local"))


@query("""SELECT event_type, count(*) FILTER (user_id % 4 <> 0) AS attempted, count(*) FILTER (user_id % 4 = 1) AS succeeded, count(*) FILTER (user_id % 8 = 1) AS rescued FROM events GROUP BY event_type""")
def fallback_counts(spark, d):
    e = table(spark, d, "events").withColumn("fallback_ok", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4 == 1)).withColumn("rescued", F.col("user_id") % 8 == 1)
    return outcomes.fallback_counts(e, "event_type")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'pipeline_error' ELSE 'validation_fail' END AS failure FROM events WHERE event_type = 'error' OR user_id % 3 <> 0""")
def failure_list(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 3 == 0).alias("matched"))
    return outcomes.failures(e).select("event_id", "failure")


CATALOGUE = (("generic.validation_failed", "Validasi gagal."), ("ktp.wrong_document", "Bukan KTP."), ("ktp.expired", "KTP kedaluwarsa."))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Bukan KTP.' WHEN 1 THEN 'Nama pada SKCK tidak cocok.' WHEN 2 THEN 'Validasi gagal.' END AS error_message FROM orders""")
def error_messages(spark, d):
    codes = F.array(F.lit("ktp.wrong_document"), F.lit("skck.name_mismatch"), F.lit("skck.odd"), F.lit(None).cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(codes, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("error_code"), F.lit("skck").alias("profile"))
    return outcomes.with_messages(rows, spark.createDataFrame(CATALOGUE, "code string, message string")).select("o_orderkey", "error_message")


@query("SELECT event_type AS document, list_sort(list(DISTINCT event_type || '.' || (user_id % 5)::VARCHAR))::VARCHAR AS codes FROM events GROUP BY 1")
def error_catalogue_grouped(spark, d):
    codes = table(spark, d, "events").select(F.concat_ws(".", "event_type", (F.col("user_id") % 5).cast("string")).alias("code")).distinct()
    return outcomes.catalogue_by_document(codes).select("document", F.concat(F.lit("["), F.array_join("codes", ", "), F.lit("]")).alias("codes"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 AND o_custkey % 3 = 0 THEN 'EXPIRED,MARITAL_STATUS' WHEN o_custkey % 5 = 0 THEN 'EXPIRED' WHEN o_custkey % 3 = 0 THEN 'MARITAL_STATUS' ELSE '' END
 || CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 5 = 0 OR o_custkey % 3 = 0 THEN ',IDENTITY' ELSE 'IDENTITY' END ELSE '' END AS blockers, (o_orderkey % 2 <> 0 AND o_custkey % 3 <> 0 AND o_custkey % 5 <> 0) AS document_matched FROM orders""")
def gate_chain(spark, d):
    own = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("IDENTITY"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", own.alias("blockers"), (F.col("o_orderkey") % 2 != 0).alias("document_matched"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 3 != 0).otherwise(F.when(F.col("o_custkey") % 3 == 0, False)).alias("marital_pass"), (F.col("o_custkey") % 5 != 0).alias("expiry_pass"),
    )
    return outcomes.chain(rows).select("o_orderkey", F.array_join("blockers", ",").alias("blockers"), "document_matched")


@query("""SELECT o_orderkey, o_custkey % 3 = 1 AND (o_custkey % 100) / 100 BETWEEN 0.012 AND 0.75 AS face_pass, (o_orderkey % 100) / 100 >= 0.32 AND (o_custkey % 10) / 20 <= 0.22 AS background_pass FROM orders""")
def portrait_gates(spark, d):
    gate = outcomes.portrait_gate(F.col("o_custkey") % 3, (F.col("o_custkey") % 100) / 100, (F.col("o_orderkey") % 100) / 100, (F.col("o_custkey") % 10) / 20)
    return table(spark, d, "orders").withColumn("g", gate).select("o_orderkey", "g.face_pass", "g.background_pass")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 3 > 0 ELSE o_orderkey % 4 IN (0, 1) END AS stamp_pass FROM orders""")
def stamp_gates(spark, d):
    said = F.element_at(F.array(F.lit("METERAI  TEMPEL"), F.lit("e-materai"), F.lit("Materai Rp10000"), F.lit(None).cast("string")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", outcomes.stamp_gate(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3, said).alias("stamp_pass"))


@query("SELECT p_partkey, 'nama ' || CASE WHEN p_size % 2 = 0 THEN '✓' ELSE '✗' END || ' (' || p_size || '%) · pendidikan tidak dicek' AS line FROM part")
def match_summary(spark, d):
    return table(spark, d, "part").select("p_partkey", outcomes.summary([("nama", F.col("p_size") % 2 == 0, F.col("p_size")), ("pendidikan", F.lit(None).cast("boolean"), F.lit(0))]).alias("line"))


@query("SELECT c_custkey, '320' || lpad(c_custkey::VARCHAR, 13, '0') AS member, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM customer")
def family_members(spark, d):
    """The family's own number is no member; numbers with spaces count by whole lines, else runs of 16."""
    own, other = F.concat(F.lit("320"), number(13)), F.concat(F.lit("321"), number(13))
    family = F.concat(F.lit("No. 9999999999999999\n"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(family, F.lit("320 "), number(13), F.lit("\n"), other, F.lit("\n"), other)).otherwise(F.concat(family, F.lit("nik "), own, F.lit(" x 1")))
    m = table(spark, d, "customer").withColumn("m", ids.member_ids(text))
    return m.select("c_custkey", F.get("m", F.lit(0)).alias("member"), F.size("m").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y') END AS born FROM orders")
def birthdate_in_text(spark, d):
    """The date in the number, women's days plus 40, shown in the text with two-digit or whole years; or another day's."""
    day = F.to_date("o_orderdate")
    code = F.lpad((F.dayofmonth(day) + F.when(F.col("o_orderkey") % 2 == 0, 40).otherwise(0)).cast("string"), 2, "0")
    nik = F.concat(F.lit("320112"), code, F.date_format(day, "MMyy"), F.lit("0001"))
    shown = F.when(F.col("o_custkey") % 2 == 0, day).otherwise(F.date_add(day, 1))
    text = F.concat(F.lit("lahir "), F.when(F.col("o_orderkey") % 3 == 0, F.date_format(shown, "d/M/yy")).otherwise(F.date_format(shown, "dd.MM.yyyy")))
    return table(spark, d, "orders").select("o_orderkey", ids.birthdate_in(text, nik).alias("born"))


@query("""SELECT c_custkey, ['Usep Maulidin', 'BUDI SANTOSO'][1 + (c_custkey % 2)::INT] AS found, c_custkey % 2 = 1 AS trailing FROM customer""")
def refined_names(spark, d):
    text = F.when(F.col("c_custkey") % 2 == 0, F.lit("Selamat siang, Usep Maulidin!")).otherwise(F.lit("saldo BUDI SANTOSO 12"))
    expected = F.when(F.col("c_custkey") % 2 == 0, F.lit("Usep Maulidin")).otherwise(F.lit("Ahmad Budi Santoso"))
    first = F.get(T.refined_names(text), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", first.alias("found"), T.is_trailing_name(first, expected).alias("trailing"))


@query()
def participant_status(spark, d):
    """Screens of three members whose statuses follow, precede or are absent; the expected one has a name over two lines."""
    text = F.concat(F.lit("Nama Peserta: BUDI SANTOSO (AKTIF)\nFaskes\nKLINIK X\nSITI\nAMINAH\n"), F.when(F.col("c_custkey") % 2 == 0, "TIDAK AKTIF").otherwise("AKTIF"), F.lit("\nAP*** SU****"))
    docs = table(spark, d, "customer").select("c_custkey", text.alias("text"), F.lit("Siti Aminah").alias("expected"))
    return participants.status(docs, "text", "expected").select("c_custkey", F.col("member.name").alias("name"), "member_status", F.size("members").alias("n"))


@query("SELECT doc_id, NOT (doc_id % 3 = 1) AS health_pass FROM documents")
def health_conclusion(spark, d):
    said = F.element_at(F.array(F.lit("dinyatakan SEHAT"), F.lit("sehat / tidak sehat: TIDAK  FIT"), F.lit("Sehat / Tidak Sehat")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", health.healthy(said).alias("health_pass"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN day END AS given, (day + 14) AS until FROM (SELECT o_orderkey, (o_orderdate + INTERVAL 30 YEAR)::DATE AS day FROM orders)")
def health_letters(spark, d):
    """The day of each order thirty years on, written by name, beside a birth date, and how long it holds."""
    day = F.add_months(F.to_date("o_orderdate"), 360)
    names = F.array(*(F.lit(m) for m in health.dates.MONTH_NAMES))
    written = F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string"))
    text = F.concat(F.lit("Lahir 12-03-1995 Bekasi. sehat berlaku 2 (dua) minggu. Demikian surat ini dibuat, Bekasi "), written, F.lit(" dokter"))
    rows = health.gate(table(spark, d, "orders").withColumn("text", text), "text", 2020, 2035)
    iso = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm")).otherwise(F.lit("2024-02-30"))
    return rows.select("o_orderkey", health.iso_day(iso).alias("given"), F.col("valid_until").alias("until"))


@query("""SELECT o_orderkey, coalesce(rescued, false) AS type_pass, CASE WHEN rescued THEN 0.7 ELSE 0.5 END AS type_ratio, CASE WHEN rescued THEN 0.3 END AS lacked FROM (
 SELECT o_orderkey, o_custkey % 7 <> 0 AND CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 2 = 0 WHEN 1 THEN o_custkey % 2 = 0 OR o_custkey % 3 = 0 WHEN 2 THEN o_custkey % 3 = 0
 WHEN 3 THEN o_custkey % 2 = 0 AND o_custkey % 3 = 0 ELSE false END AS rescued FROM orders)""")
def type_rescues(spark, d):
    """Tax cards by their number, identity cards by fields, participant screens by the holder, statements by account; excluded ones never."""
    half, third = F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0
    text = F.array(
        F.when(half, "NPWP 12.345 1234567890123456").otherwise("NPWP"),
        F.when(half, "1234567890123456 WNI lahir RT/RW").otherwise("1234567890123456 WNI lahir"),
        F.lit("Info  Peserta"), F.lit("e-statement"), F.lit("ijazah"),
    )
    nth = lambda names: F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", nth(F.array(*(F.lit(p) for p in ("npwp", "ktp", "jkn", "mutasi", "ijasah")))).alias("profile"), nth(text).alias("text"), (F.col("o_custkey") % 7 == 0).alias("exclusion"),
        F.lit(False).alias("type_pass"), F.when(third, True).alias("identity_pass"), half.alias("bank_pass"), third.alias("account_pass"),
        F.lit(0.4).alias("aggregate"), F.lit(0.5).alias("type_ratio"), F.create_map(F.lit("structural"), F.lit(0.1)).alias("boosts"),
    )
    anchor = F.get(F.map_values(F.map_filter("boosts", lambda k, _: k.endswith("_anchor"))), F.lit(0))
    return outcomes.rescue_type(rows).select("o_orderkey", "type_pass", "type_ratio", anchor.alias("lacked"))
