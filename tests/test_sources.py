import json

import __spark_entry__ as entry
from verifold.sources import files


def test_files(spark, tmp_path):
    for name in ("ktp/a.jpg", "ktp/b.PDF", "ktp/.hidden.pdf", "ktp/c.exe", ".x/d.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.file for r in files.documents(spark, str(tmp_path)).collect()) == ["a.jpg", "b.PDF"]
    people = [{"nik": "3200000000000001", "selected_bank": "A", "nomor_rekening_bank": "1234567890"}, {"nomor_ktp": "3200000000000001", "selected_bank": "B"}, {"nik": "12", "selected_bank": "C"}]
    (tmp_path / "m.json").write_text(json.dumps({"employees": people}))
    got = {k: {r.key: r.value for r in v.collect()} for k, v in files.manifest(spark, str(tmp_path / "m.json")).items()}
    assert got == {"bank_by_id": {"3200000000000001": "b"}, "account_by_id": {"3200000000000001": "1234567890"}, "bank_by_account": {"1234567890": "a"}}
    (tmp_path / "log.jsonl").write_text('{"id": "1"}\nbroken\n{"id": "2"}\n')
    assert files.log(spark, str(tmp_path / "log.jsonl"), "id string").count() == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
