"""Fuzzy identity of person names, as one vectorised UDF over pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as Ty
from pyspark.sql.functions import pandas_udf

from .fuzzy import ratio, struct_of, token_sort_ratio, wratio
from .text import DIGIT_TO_LETTER, HONORIFICS

FOLD = str.maketrans(*DIGIT_TO_LETTER)
SKIP = frozenset(HONORIFICS) | {"nama", "name", "nik", "no", "nomor", "alamat"}
#: Fixed thresholds: tokens alike, the score of a pass, the most without one, the least with a rescue.
ALIKE, PASS, CAP, FLOOR = 80.0, 65.0, 45.0, 70.0


def name_tokens(name: str | None) -> list[str]:
    plain = re.sub(r"[^\w\s]", " ", (name or "").lower())
    return [t for t in (w.translate(FOLD) for w in plain.split()) if t not in SKIP]


def required(n: int) -> int:
    """How many tokens of n must be found."""
    return n if n <= 2 else max(2, n - 1)


def greedy(found: list[str], expected: list[str], alike: float = ALIKE) -> list[float]:
    """Scores of one-to-one matches, best first, equal ones in the order of the pairs."""
    pairs = sorted(((ratio(f, e), i, j) for i, f in enumerate(found) for j, e in enumerate(expected)), key=lambda p: -p[0])
    used_f, used_e, out = set(), set(), []
    for score, i, j in pairs:
        if score >= alike and i not in used_f and j not in used_e:
            used_f.add(i)
            used_e.add(j)
            out.append(score)
    return out


def rescue(found: list[str], expected: list[str]) -> str | None:
    """Whether the names are the same but for gluing or cutting."""
    f, e = "".join(found), "".join(expected)
    if len(e) >= 8 and f == e:
        return "glued"
    if len(f) >= 8 and len(e) > len(f) and e.startswith(f) and len(f) >= 0.68 * len(e):
        return "prefix"
    if min(len(f), len(e)) >= 8 and abs(len(f) - len(e)) <= 2 and ratio(f, e) >= 92:
        return "near_glued"
    if len(found) >= 2 and len(expected) >= 3 and found[0] == expected[0]:
        if found[-1] == expected[-1]:
            return "first_last"
        if found[1] == expected[1]:
            return "first_two"
    return None


def identity_score(found: str | None, expected: str | None) -> dict:
    f, e = name_tokens(found), name_tokens(expected)
    if not f or not e:
        return {"score": 0.0, "matched": 0, "required": required(len(e)), "gate": False, "rescue": None, "sort_ratio": 0.0, "diagnostic": 0.0}
    matched = greedy(f, e)
    need = required(len(e))
    cover_e, cover_f = len(matched) / len(e), len(matched) / len(f)
    harmonic = 200 * cover_e * cover_f / (cover_e + cover_f) if matched else 0.0
    a, b = " ".join(f), " ".join(e)
    sort = token_sort_ratio(a, b)
    how = None if len(matched) >= need else rescue(f, e)
    gate = len(matched) >= need or how is not None
    score = max(harmonic, sort)
    score = max(score, FLOOR) if how else score if gate else min(score, CAP)
    return {"score": round(score, 6), "matched": len(matched), "required": need, "gate": gate and score >= PASS, "rescue": how, "sort_ratio": sort, "diagnostic": wratio(a, b)}


@pandas_udf(
    struct_of(
        score=Ty.DoubleType(), matched=Ty.IntegerType(), required=Ty.IntegerType(), gate=Ty.BooleanType(), rescue=Ty.StringType(), sort_ratio=Ty.DoubleType(), diagnostic=Ty.DoubleType()
    )
)
def identity(found: pd.Series, expected: pd.Series) -> pd.DataFrame:
    known: dict[tuple, dict] = {}
    return pd.DataFrame([known.get(p) or known.setdefault(p, identity_score(*p)) for p in zip(found, expected, strict=True)])


def masked_same_length(shown: str, name: str) -> bool:
    """``Bxxi`` for ``Budi``: letters that are not masked agree."""
    return len(shown) == len(name) and any(c in "xX*" for c in shown) and all(c in "xX*" or c.lower() == n.lower() for c, n in zip(shown, name, strict=True))


def masked_prefix(shown: str, name: str) -> bool:
    """``BUXX CONXX``: each token's letters before the mask begin the name's next matching token."""
    rest = name.lower().split()
    for token in shown.lower().split():
        head = re.sub(r"[x*]+$", "", token)
        hit = next((i for i, n in enumerate(rest) if head and n.startswith(head)), None)
        if hit is None:
            return False
        rest = rest[hit + 1 :]
    return bool(shown.split())


def holder(shown: str | None, name: str | None) -> tuple[bool, str | None]:
    """An account holder's name: whole, or token by token exact, masked or glued."""
    if not shown or not name:
        return False, None
    whole = identity_score(shown, name)
    if whole["gate"] and whole["score"] >= PASS and whole["matched"] >= whole["required"]:
        return True, "full"
    a, b = shown.split(), name.split()
    if len(a) == len(b) and all(x.lower() == y.lower() or masked_same_length(x, y) for x, y in zip(a, b, strict=True)):
        return True, "masked"
    if masked_prefix(shown, name) and any(c in "xX*" for c in shown):
        return True, "masked_prefix"
    if "".join(a).lower() == "".join(b).lower() and len("".join(a)) >= 8:
        return True, "glued"
    return False, None


@pandas_udf(Ty.StructType([Ty.StructField("pass", Ty.BooleanType()), Ty.StructField("method", Ty.StringType())]))
def holder_match(shown: pd.Series, name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([holder(*p) for p in zip(shown, name, strict=True)], columns=["pass", "method"])


def join_spaced(line: str) -> str:
    """Letters set apart are one word again."""
    out: list[str] = []
    single = False
    for token in line.split():
        if len(token) == 1 and token.isalpha() and single:
            out[-1] += token
        else:
            out.append(token)
        single = len(token) == 1 and token.isalpha()
    return " ".join(out)


@pandas_udf(Ty.StringType())
def repair_spacing(line: pd.Series) -> pd.Series:
    return line.map(lambda s: s if s is None else join_spaced(s))
