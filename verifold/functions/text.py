"""Text normalisation as column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that recognition confuses with letters, and back.
DIGIT_TO_LETTER = ("01234568", "oizeasgb")
LETTER_TO_DIGIT = ("OoQDIilLZzSsBbGg", "0000111122558866")
#: Titles and forms of address before or after names.
HONORIFICS = ("bapak", "bpk", "ibu", "sdr", "sdri", "saudara", "saudari", "tuan", "nyonya", "mr", "mrs", "ms", "dr", "drs", "dra", "ir", "prof", "h", "hj")


def normalize(text: Column) -> Column:
    """Trimmed, lower-cased, every run of white space one space (so line ends vanish)."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def normalize_name(text: Column) -> Column:
    """Hyphens, slashes and marks become spaces, titles and a trailing ellipsis go, edges are trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(text), r"[-_/:;|]", " "), r"(\.\.\.|…)\s*$", "")
    bare = F.regexp_replace(spaced, rf"\b({'|'.join(HONORIFICS)})\b\.?(?=\s|$)", " ")
    return F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(" ."))


def normalize_keyword(text: Column) -> Column:
    return normalize(F.translate(text, "/", " "))


def fold_digits(text: Column) -> Column:
    """Digits that stand for letters."""
    return F.translate(text, *DIGIT_TO_LETTER)


def fold_letters(text: Column) -> Column:
    """Letters that stand for digits, in numbers."""
    return F.translate(text, *LETTER_TO_DIGIT)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def compact(text: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def truncate(text: Column, most: int) -> Column:
    """At most that many characters, the last three being dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def preview(text: Column, most: int = 240) -> Column:
    """The first characters with line ends as spaces."""
    return F.left(F.translate(text, "\r\n", "  "), F.lit(most))


def first_text(*columns: Column) -> Column:
    """The first that holds more than white space, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def flatten_html(html: Column) -> Column:
    """Line breaks and closing blocks become line ends, other tags spaces, entities characters."""
    lines = F.regexp_replace(html, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table)>", "\n")
    bare = F.regexp_replace(lines, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t]+", " "))


def segments(text: Column) -> Column:
    """Cut at line ends, bars and bullets; trimmed; empty ones and table rules gone."""
    parts = F.transform(F.split(text, r"[|\n•·]"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (s != "") & ~s.rlike(r"^[-:\s]+$"))


def windows(parts: Column, *widths: int) -> Column:
    """Neighbouring elements joined by a space, for each width."""
    def of(w: int) -> Column:
        starts = F.when(F.size(parts) >= w, F.sequence(F.lit(1), F.size(parts) - (w - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, w), " "))

    made = [of(w) for w in widths]
    return F.array_distinct(F.concat(*made))


def is_person_name(text: Column) -> Column:
    """Two to six words of letters, mostly long enough, no digits, no label before a colon."""
    words = F.split(F.trim(text), r"\s+")
    return (
        F.size(words).between(2, 6)
        & ~text.rlike(r"[0-9:@/]")
        & (F.length(compact(text)) >= 5)
        & F.forall(words, lambda w: w.rlike(r"(?U)^[\p{L}.'’-]+$"))
        & (F.size(F.filter(words, lambda w: F.length(w) >= 3)) >= 1)
    )


def title_from_filename(name: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_-", "  "))


def document_key(name: Column, content: Column) -> Column:
    """name:first 16 of the content's sha256."""
    return F.concat_ws(":", name, F.left(F.sha2(content, 256), F.lit(16)))


def chunk_key(doc: Column, path: Column, content: Column) -> Column:
    """First 32 of the sha256 of document, section path and the content's first 80 characters."""
    return F.left(F.sha2(F.concat_ws("|", doc, path, F.left(content, F.lit(80))), 256), F.lit(32))


#: Words of forms that are never part of a person's name.
FIELD_WORDS = (
    "kewarganegaraan", "wni", "wna", "perkawinan", "kawin", "bekerja", "tidak", "islam", "kristen", "katolik", "hindu", "buddha",
    "konghucu", "perempuan", "laki", "lakilaki", "seumur", "hidup", "berlaku", "hingga", "tempat", "lahir", "agama", "status",
    "pekerjaan", "alamat", "kecamatan", "kelurahan", "desa", "provinsi", "kabupaten", "belum", "cerai", "meninggal", "dusun", "gol", "darah",
)
#: Labels that stand alone.
SINGLE_LABELS = ("nama", "nana", "name", "nik", "npwp", "ttl", "wni", "wna")
#: How a place begins, greetings, and names after a greeting, after a comma and in capitals.
PLACE_START = r"(?i)^(kota|kab\.?|kabupaten|kecamatan|kelurahan|provinsi|desa)\b"
GREETING_START = r"(?i)^(?:selamat\s+(?:pagi|siang|sore|malam|datang)|halo|hai|hi|hello)\s*[,!]?\s*"
GREETED_NAME = (
    r"(?i)(?:^|[\s,.])(?:selamat\s+(?:pagi|siang|sore|malam)|halo|hai|hi|hello)\s*[,!]?\s*([a-z][a-z\s'.-]{2,50}?)"
    r"(?=\s*[!?.]|\s+(?:mau|ingin|dan|yang|untuk|silakan|welcome|good|terima)\b|$)"
)
NAME_AFTER_COMMA = r",\s*([A-Za-z][A-Za-z\s'.-]{2,50}?)(?=\s*[!?.]|\s{2,}|\s+[a-z]{3,}\b|$)"
CAPITALS = r"\b([A-Z]{3,}(?:\s+[A-Z]{2,})+)\b"


def trim_marks(text: Column) -> Column:
    """Without sentence marks at the end."""
    return F.trim(F.regexp_replace(F.trim(text), r"[!?.;]+$", ""))


def latin_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def has_field_word(text: Column) -> Column:
    return F.exists(tokens(text), lambda w: w.isin(*FIELD_WORDS))


def is_field_label(text: Column) -> Column:
    """Empty, three letters at most, a label, or the start of place and day of birth."""
    s = normalize(text)
    return (F.length(s) <= 3) | s.isin(*SINGLE_LABELS) | F.replace(s, F.lit(" "), F.lit("")).rlike("^(tempat|ttl|lahir)")


def is_birthplace_noise(text: Column) -> Column:
    s = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    return s.contains("tempat") | (s.startswith("ttl") & (F.length(s) <= 12)) | (s.contains("lahir") & (F.length(s) <= 14))


def looks_like_name(text: Column) -> Column:
    """Mostly letters, no field word, place, date or long number; a lone word is in capitals or long.  Null: false."""
    s = F.trim(text)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    plain = (F.length(s) >= 4) & (letters >= 3) & (letters / F.length(s) >= 0.45)
    other = has_field_word(s) | is_birthplace_noise(s) | s.rlike(PLACE_START) | s.rlike(r"\d{10,}|\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b")
    lone = (letters >= 4) & (letters >= 0.85 * F.length(s)) & (F.upper(s) == s) & (F.length(s) <= 40)
    return F.coalesce(plain & ~other & (s.rlike(r"\s") | lone | (F.length(s) >= 8)), F.lit(False))


def refined_names(segment: Column) -> Column:
    """Narrower candidates of a segment: behind a greeting, behind a comma, runs of capitals; in this order, none twice."""
    s = F.trim(F.coalesce(segment, F.lit("")))
    greeted = F.trim(F.regexp_replace(s, GREETING_START, ""))
    clause = F.when(greeted != s, F.array(F.get(F.split(greeted, "[!?]"), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    found = F.concat(clause, *(F.regexp_extract_all(s, F.lit(p), 1) for p in (GREETED_NAME, NAME_AFTER_COMMA, CAPITALS)))
    return F.array_distinct(F.filter(F.transform(found, trim_marks), looks_like_name))


def name_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, apostrophes left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "['`´’]", "")), F.lit("[a-z0-9]+"), 0)


def is_trailing_name(shown: Column, expected: Column, least: int = 8) -> Column:
    """Whether the shown words are the last of a longer expected name, with that many letters."""
    got, want = name_words(shown), name_words(expected)
    tail = F.slice(want, F.size(want) - F.size(got) + 1, F.size(got))
    shorter = (F.size(got) > 0) & (F.size(got) < F.size(want))
    return F.coalesce(F.when(shorter, (tail == got) & (F.length(F.array_join(got, "")) >= least)), F.lit(False))


#: Titles and headings of CVs, and lines that tell of jobs, prose, firms and addresses.
CV_NOISE = (
    "tentang saya", "about me", "profil", "ringkasan profil", "summary", "curriculum vitae", "cv", "daftar riwayat hidup", "data pribadi",
    "personal data", "kontak", "contact", "fresh graduate", "fresh graduete", "fresh graduation", "lulusan baru", "pendidikan", "education",
    "keahlian", "skills", "pengalaman", "pengalaman kerja", "organisasi", "bahasa", "hobi", "media sosial", "referensi", "pelatihan", "sertifikasi",
    "status", "email", "telepon", "phone", "alamat", "address", "experience", "riwayat pendidikan", "riwayat pekerjaan", "work experience", "no data",
)
CV_OTHER = (
    r"[★☆⭐◇◆●○◎✓✗☑☒]|^#+\s*(?:halaman\s*)?\d*\s*$|@|\d{5,}"
    r"|\b(fresh\s+grad\w*|lulusan\s+baru|mahasiswa|student|internship|magang|undergraduate)\b"
    r"|\b(mampu|dapat|memiliki|berpengalaman|mengoperasikan|bertanggung|berkomitmen|semangat|kepada|perusahaan|windows|microsoft|troubleshooting)\b"
    r"|\b(pt\.?|cv\.?|ud\.?|tbk\.?|persero)\b"
    r"|\b(jl\.?|jalan|street|grand\s+mutiara|kec\.|kel\.|kab\.)\b"
)


def cv_line(text: Column) -> Column:
    """Without a bullet at its start."""
    return F.trim(F.regexp_replace(F.trim(text), r"^[-•*|]+\s*", ""))


def is_cv_name_line(text: Column) -> Column:
    """A line of a CV that may be its owner's name, whoever is expected."""
    s = cv_line(text)
    prose = (F.length(s) > 55) & (s.endswith(".") | s.contains(","))
    other = s.rlike("(?i)" + CV_OTHER) | normalize(s).isin(*CV_NOISE) | prose
    lone = s.rlike("^[A-Z'.-]{4,30}$")
    return F.coalesce(s.rlike("[A-Za-z]{3,}") & ~other & (lone | looks_like_name(s)), F.lit(False))
