import json

import pytest
from pyspark.sql import functions as F

from verifold.functions.loose_json import loose, loose_json
from verifold.operators import extract, search


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1, "B": "x"}', {"a": 1, "b": "x"}),
        ("```json\n{a: ya, b: 0123, c: true\n d: [1, two, \"3\"]}\n```", {"a": "ya", "b": "0123", "c": True, "d": [1, "two", "3"]}),
        ("- is_ktp: true\n- holder_name: BUDI CONTOH\n- nik: null", {"is_ktp": True, "holder_name": "BUDI CONTOH", "nik": None}),
        ('<think>{"a": 2}</think>{"a": 1, "b": "cut o', {"a": 1, "b": "cut o"}),
        ('{"m": [{"name": "A", "nik": "1"}, {"name": "B"', {"m": [{"name": "A", "nik": "1"}, {"name": "B"}]}),
        ("no object here", None),
        ("", None),
        (None, None),
        ("{{{{", None),
    ],
)
def test_loose_json(reply, want):
    assert loose(reply) == want


def test_loose_json_column(spark):
    rows = spark.createDataFrame([("{a: 1",), (None,)], "t string").select(loose_json("t").alias("j")).collect()
    assert json.loads(rows[0].j) == {"a": 1} and rows[1].j is None


def test_names(spark):
    docs = spark.createDataFrame([(1, "KARTU 12\nNama : Budi Contoh | umur 3\nSITI CONTOH LAIN"), (2, None), (3, "")], "doc_id int, text string")
    found = extract.name_candidates(docs)
    assert {(r.doc_id, r.norm, r.method) for r in found.collect()} >= {(1, "budi contoh", "label"), (1, "siti contoh lain", "segment")}
    best = extract.best_name(found, spark.createDataFrame([(1, "budi contoh"), (2, "x")], "doc_id int, expected_name string")).collect()
    assert [(r.doc_id, r.candidate, r.identity_pass) for r in best] == [(1, "Budi Contoh", True)]


def test_members_and_banks(spark):
    docs = spark.createDataFrame([(1, "Budi Contoh\n3200000000000001\nSiti Contoh\n3200000000000002"), (2, "Budi Contoh")], "doc_id int, text string")
    assert [(r.name, r.nik) for r in extract.zipped_members(docs).orderBy("pos").collect()] == [("Budi Contoh", "3200000000000001"), ("Siti Contoh", "3200000000000002")]
    banks = {"one": ("bank one", "one mobile"), "two": ("bank two",)}
    got = spark.createDataFrame([("Bank ONE saldo",), ("bank one, bank two",), ("",)], "t string").select(extract.bank_of(F.col("t"), banks).alias("b")).collect()
    assert [r.b for r in got] == ["one", None, None]


def test_plain_sections(spark):
    docs = spark.createDataFrame([(1, "Budi\n## Halaman 2\nPendidikan\nS1\nPENGALAMAN KERJA\nx\ny")], "doc_id int, text string")
    got = {r.section: (r.title, r.content) for r in search.plain_sections(docs).collect()}
    assert got == {0: (None, "Budi"), 1: ("Pendidikan", "S1"), 2: ("PENGALAMAN KERJA", "x\ny")}
    assert search.chunks(search.plain_sections(docs), least=1).count() == 3
