"""Members on insurance screens and cards: who is listed and with which status."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.functions import pandas_udf

from ..functions import ids, names
from ..functions import text as T
from ..functions.fuzzy import struct_of

#: Words before a value that isn't a name, beginnings of facilities and roles, and the labels.
SKIP = ("faskes", "lahir", "kelas", "kelompok", "tagihan", "saldo", "sisa")
ROLES = ("klinik", "puskesmas", "pkm", "peserta", "anak", "istri", "klg", "keluarga tambahan", "nomor kartu", "jumlah jiwa", "karna premi", "penangguhan")
STATUS = r"[(\[]?\s*(?:tidak\s*aktif|non[\s-]*aktif|nonaktif|aktif)(?:\s*\([^)]*\))?[\s)\]]*"
LABEL = r"\s*(nama|status)\s*peserta\s*:?\s*(.+)"
MASKED = r"[a-z]{1,5}[x*]{2,}"
#: The least score of a picked member and the score of a masked name that fits.
LEAST, MASKED_SCORE = 65.0, 92.0
MEMBERS = Ty.ArrayType(struct_of(name=Ty.StringType(), status=Ty.StringType()))


def status_of(text: Column) -> Column:
    """aktif, tidak_aktif or null."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.when(letters.rlike("tidakaktif|nonaktif"), "tidak_aktif").when(letters.contains("aktif"), "aktif")


def read_status(line: str) -> str | None:
    letters = re.sub("[^a-z]", "", line.lower())
    if re.search("tidakaktif|nonaktif", letters):
        return "tidak_aktif"
    return "aktif" if "aktif" in letters else None


def without_status(line: str) -> str:
    return " ".join(re.sub(STATUS, " ", line, flags=re.I).split()).strip(" -")


def capital_name(line: str) -> bool:
    """In capitals or masked, and no facility, role or field."""
    bare = re.sub(r"[!?.;]+$", "", line.strip()).strip()
    words = re.sub(r"[()\[\]{}]", " ", bare.lower()).split()
    if words and all(re.fullmatch(MASKED, w.replace("*", "x")) for w in words):
        return True
    letters = re.sub("[^A-Za-z]", "", bare)
    if not words or words[0] in SKIP or bare.lower().startswith(ROLES) or len(letters) < max(3, len(bare) / 2):
        return False
    return letters.isupper() and (len(words) > 1 or len(letters) >= 4)


def kinds(lines: list[str]) -> Iterator[tuple[str, str, str | None]]:
    """(kind, name, status) of each line that tells something: ``named``, ``name`` or ``status``."""
    value_follows = False
    for line in lines:
        label = re.fullmatch(LABEL, line, flags=re.I)
        low = line.lower()
        marker = next((m for m in SKIP if low.startswith(m)), None)
        if label:
            said = read_status(label[2])
            if label[1].lower() == "status":
                yield "status", "", said
            else:
                yield "named", without_status(label[2]), said
        elif low.startswith("jenis peserta") or re.fullmatch(r"[\d\s.:/-]+", line):
            continue
        elif low.startswith(ROLES) or "pekerja bukan" in low or "penerima upah" in low:
            value_follows = False
        elif marker:
            rest = low[len(marker) :].strip(" :.-")
            value_follows = value_follows or not rest or (marker == "faskes" and re.fullmatch(r"\d{1,2}", rest) is not None)
        elif value_follows:
            value_follows = False
        else:
            name = without_status(line)
            yield ("name", name, read_status(line)) if capital_name(name) else ("status", "", read_status(line))


def listed(lines: list[str]) -> list[dict]:
    """Members in order: a name goes on over lines until a status is said, and the first status said counts."""
    members: list[dict] = []
    for kind, name, status in kinds(lines):
        name = re.sub(r"[!?.;]+$", "", name).strip()
        last = members[-1] if members else None
        if kind == "status":
            if last and status and not last["status"]:
                last["status"] = status
        elif name:
            if kind == "name" and last and not last["status"] and capital_name(last["name"]):
                last["name"], last["status"] = f"{last['name']} {name}", status
            else:
                members.append({"name": name, "status": status})
    return members


@pandas_udf(MEMBERS)
def members_of(lines: pd.Series) -> pd.Series:
    return pd.Series([listed([s for s in (x or "" for x in line) if s]) if line is not None else [] for line in lines], dtype=object)


def members(text: Column) -> Column:
    """array of struct(name, status) of a screen's text; empty for null."""
    return members_of(T.segments(F.coalesce(text, F.lit(""))))


def masked_fits(shown: str, name: str) -> bool:
    return any(c in "xX*" for c in shown) and names.masked_prefix(shown, name)


@pandas_udf(struct_of(position=Ty.IntegerType(), score=Ty.DoubleType()))
def pick(members: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Place (from 1) and score of the member who fits an expected name best, the first of equal ones; null under 65.

    Without an expected name a lone member is picked."""

    def one(listed, name):
        listed = [] if listed is None else listed
        if not (name or "").strip():
            return (1, None) if len(listed) == 1 else (None, None)
        scored = [(max(names.identity_score(m["name"], name)["score"], MASKED_SCORE if masked_fits(m["name"], name) else 0.0), -i) for i, m in enumerate(listed)]
        score, place = max(scored, default=(0.0, 0))
        return (1 - place, score) if score >= LEAST else (None, None)

    return pd.DataFrame([one(*p) for p in zip(members, expected, strict=True)], columns=["position", "score"]).astype({"position": "Int32", "score": "float64"})


def status(docs: DataFrame, text: str, expected: str) -> DataFrame:
    """Adds members, member (the picked one) and member_status, which never blocks.

    The picked member's status, else that of the 180 characters from where the expected name stands;
    without an expected name, aktif if any member is, else tidak_aktif if any is.
    """
    out = docs.withColumn("members", members(F.col(text))).withColumn("_pick", pick(F.col("members"), F.col(expected)))
    out = out.withColumn("member", F.try_element_at("members", F.col("_pick.position")))
    name = F.coalesce(F.trim(F.col(expected)), F.lit(""))
    at = F.instr(F.lower(F.col(text)), F.lower(name))
    near = F.when((name != "") & (at > 0), status_of(F.substr(F.col(text), at, F.greatest(F.lit(180), F.length(name) + 80))))
    said = F.transform("members", lambda m: m["status"])
    any_one = F.when(name == "", F.when(F.array_contains(said, "aktif"), "aktif").when(F.array_contains(said, "tidak_aktif"), "tidak_aktif"))
    return out.withColumn("member_status", F.coalesce(F.col("member.status"), near, any_one)).drop("_pick")


def beside_numbers(text: Column) -> Column:
    """The lines before and after each line whose digits are 16, that hold no digit themselves; in order, none twice."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != "")
    place = F.transform(lines, lambda s, i: F.when(F.length(ids.digits_only(s)) == 16, i))
    near = F.flatten(F.transform(F.array_compact(place), lambda i: F.array(F.get(lines, i - 1), F.get(lines, i + 1))))
    return F.array_distinct(F.filter(near, lambda s: s.isNotNull() & ~s.rlike(r"\d")))


def merged_capitals(lines: Column) -> Column:
    """Lines of capitals with two words or more take the one-word line of capitals that follows; each line is used once."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def step(held: Column, line: Column) -> Column:
        capitals = F.upper(line) == line
        lone = capitals & ~line.rlike(r"\s|\d") & (F.length(line) >= 4)
        joins = held["open"] & lone
        last = F.element_at(held["out"], -1)
        grown = F.concat(F.slice(held["out"], 1, F.size(held["out"]) - 1), F.array(F.concat_ws(" ", last, line)))
        return F.struct(F.when(joins, grown).otherwise(F.concat(held["out"], F.array(line))).alias("out"), (~joins & capitals & line.rlike(r"\S\s+\S")).alias("open"))

    return F.aggregate(lines, start, step, lambda held: held["out"])


def cv_headers(docs: DataFrame, text: str, *keys: str, most_lines: int = 16) -> DataFrame:
    """keys, position, line, score of the name-like lines among a CV's first 16: earlier, in capitals and of few words is better."""
    lines = F.transform(F.slice(F.split(F.coalesce(F.col(text), F.lit("")), r"[\n|]+"), 1, most_lines), T.cv_line)
    each = docs.select(*keys, F.posexplode(lines).alias("position", "line")).where(T.is_cv_name_line(F.col("line")))
    words = F.size(T.tokens(F.col("line")))
    score = 24.0 - F.least(F.col("position"), F.lit(12)) + F.when((F.upper("line") == F.col("line")) & F.col("line").rlike("[A-Z]{2,}"), 10.0).otherwise(0.0)
    score = score + F.when(words.between(2, 5), 6.0).when((words == 1) & F.length("line").between(4, 30), 8.0).otherwise(0.0)
    return each.withColumn("score", score)
