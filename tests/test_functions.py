from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from verifold.functions import dates, fuzzy, ids, names
from verifold.functions import text as T

WORDS = st.text("abcde ", max_size=14)


def brute_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_metrics(a, b):
    assert fuzzy.lcs(a, b) == brute_lcs(a, b)
    for metric in fuzzy.METRICS.values():
        assert 0 <= metric(a, b) <= 100
        assert abs(metric(a, b) - metric(b, a)) < 1e-9
    assert fuzzy.ratio(a, a) == 100


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.normalize(F.col("t")), t="  A\tB\n c ") == "a b c"
    assert one(spark, T.normalize_name(F.col("t")), t="Bpk. BUDI-CONTOH ...") == "budi contoh"
    assert one(spark, T.segments(F.col("t")), t="a | b\n---\nc") == ["a", "b", "c"]
    assert one(spark, T.windows(T.segments(F.col("t")), 2, 3), t="a|b|c") == ["a b", "b c", "a b c"]
    assert one(spark, T.is_person_name(F.col("t")), t="Budi Contoh") is True
    assert one(spark, T.is_person_name(F.col("t")), t="Nama: 12") is False
    assert one(spark, T.normalize(F.col("t")), t=None) is None


def test_numbers(spark):
    assert one(spark, ids.accounts(F.col("t")), t="3200000000000001 and 3200000000 and 0000000001 and 9876543210") == ["9876543210"]
    assert one(spark, ids.national_ids(F.col("t")), t="no 3200 0000 0000 0001.") == ["3200000000000001"]
    assert one(spark, ids.same_id(F.col("a"), F.col("b")), a="32OOOOOOOOOOOOO2", b="3200000000000001") is True
    assert one(spark, ids.account_method(F.col("a"), F.col("b")), a="123456789", b="1234567890") == "missing_digit"
    assert one(spark, ids.account_method(F.col("a"), F.col("b")), a="", b="1234567890") is None
    assert one(spark, ids.birthdate(F.col("a")), a="3200004501990001").day == 5


@pytest.mark.parametrize("text", ["terbit 01-02-2024, berlaku sampai 01-02-2024", "terbit 11-2-2024 sampai 1-2-2024", "1-2-20245 sampai x1-2-2024 1-2-2024", "1 Februari 2024 sampai 1/2/2024"])
def test_repeated_dates(spark, text):
    assert str(one(spark, dates.after_label(F.col("t"), dates.found(F.col("t")), "sampai"), t=text)) == "2024-02-01"
    assert one(spark, F.size(dates.found(F.col("t"))), t="") == 0 and one(spark, F.size(dates.found(F.col("t"))), t=text) <= 2


def test_dates(spark):
    v = one(spark, dates.validity(F.col("t"), "(?i)sampai", "(?i)dari"), t="dari 3 Maret 2024 sampai 03-09-2024")
    assert (str(v["from"]), str(v["until"])) == ("2024-03-03", "2024-09-03")
    assert one(spark, F.size(dates.found(F.col("t"))), t="31 Februari 2024") == 0
    assert one(spark, dates.expiry(F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit("2024-01-01").cast("date"))) == "missing"


def test_names():
    gate = lambda a, b: names.identity_score(a, b)["gate"]
    assert gate("CONTOH BUDI", "budi contoh") and gate("8UD1 C0NTOH", "Budi Contoh") and gate("BUDICONTOH", "Budi Contoh")
    assert not gate("Budi Lain", "Budi Contoh") and names.identity_score("Budi Lain", "Budi Contoh")["score"] <= 45
    assert names.holder("BUXX CONXXX", "Budi Contoh")[0]
    assert names.holder("Bxxi", "Budi") == (True, "masked")
    assert names.join_spaced("B U D I contoh") == "BUDI contoh"
    assert not gate(None, "x")
