"""The pipeline's stages, each on its own input, against plain Python."""

import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")

from verifold.llm import byte_bpe, quality_rules  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra int, label int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    texts = [prose(40) for _ in range(80)]
    rows = [(i, t + (" you filthy moron" if i % 4 == 0 else ""), "en", "ab"[i % 2], None, 1, 1) for i, t in enumerate(texts)]
    rows += [(200, texts[1], "en", "a", None, 1, 1), (201, texts[1] + " one", "en", None, None, 1, 1), (202, None, "en", "a", None, 1, 1), (203, "", "en", "a", None, 1, 1), (204, "few words", "en", "a", None, 1, 1)]
    rows += [(None, prose(40), "en", "a", None, 1, 1), (205, prose(30) + "\nHome | About | Contact | Login", "en", "a", None, 1, 1)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, tables), name)
        kept.append(docs.collect())
        assert name == "byte_bpe" or docs.columns == corpus_pipeline.COLUMNS
    clean, good, single, mixed, ids = kept
    known = {r.doc_id for r in clean}
    assert not [i for i in known if i is not None and i < 80 and i % 4 == 0] and known >= {i for i in range(80) if i % 4}
    want = {}
    for r in clean:
        words = (r.text or "").encode().split()
        stay, lost, _ = quality_rules.clean((r.text or "").encode())
        if len(words) >= 20 and 10 * quality_rules.repeated_words(words) <= 3 * len(words) and lost <= 0.6 * len(words):
            want[r.doc_id] = stay.decode()
    assert {r.doc_id: r.text for r in good} == want and all(r.n_chars == len(r.text) for r in good) and "Home" not in want[205]
    assert {r.doc_id for r in single} == set(want) - {200, 201} and {(r.doc_id, r.text) for r in single} <= set(want.items())
    times = {}
    for r in mixed:
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    assert set(times) <= {(r.doc_id, r.text) for r in single} and max(times.values()) <= 2
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(single)) <= 0.1 * words(single)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r.doc_id or -1, list(r.ids)) for r in ids) == sorted((r.doc_id or -1, library.encode_ordinary(r.text)) for r in mixed)
