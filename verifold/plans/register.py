"""Makes the library's functions callable from SQL: ``register(spark)``, then ``SELECT identity(a, b).score ...``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import fuzzy, names
from ..functions import text as T
from ..operators import banks, health, participants

#: Vectorised functions by their SQL names.
VECTORISED = {
    "fuzzy_scores": fuzzy.scores,
    "identity": names.identity,
    "holder_match": names.holder_match,
    "repair_spacing": names.repair_spacing,
    "phrase_score": banks.phrase_score,
    "members_of": participants.members_of,
    "pick_member": participants.pick,
    "letter_dates": health.letter_dates(),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Functions that Spark inlines into the plan, as (arguments, type, expression).
INLINED = {
    "normalize_text": ("t STRING", "STRING", rf"trim(regexp_replace(lower(t), {_quoted(r'(?U)\s+')}, ' '))"),
    "digits_only": ("t STRING", "STRING", rf"regexp_replace(t, {_quoted(r'\D')}, '')"),
    "compact_text": ("t STRING", "STRING", "regexp_replace(lower(t), '[^a-z0-9]', '')"),
    "fold_digits": ("t STRING", "STRING", f"translate(t, {_quoted(T.DIGIT_TO_LETTER[0])}, {_quoted(T.DIGIT_TO_LETTER[1])})"),
    "fold_letters": ("t STRING", "STRING", f"translate(t, {_quoted(T.LETTER_TO_DIGIT[0])}, {_quoted(T.LETTER_TO_DIGIT[1])})"),
    "expiry_state": (
        "begins DATE, ends DATE, as_of DATE",
        "STRING",
        "CASE WHEN ends IS NULL THEN 'missing' WHEN begins > as_of THEN 'not_yet_valid' WHEN ends < as_of THEN 'expired' ELSE 'valid' END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all for the session and returns their names; a second call replaces them."""
    for name, udf in VECTORISED.items():
        spark.udf.register(name, udf)
    for name, (arguments, kind, body) in INLINED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [*VECTORISED, *INLINED]
