"""Operators that judge documents one by one, and the edge cases that all of them define."""

import hashlib
import pickle
import re
import zlib

import numpy as np
import pytest

from verifold.llm import byte_bpe, chat_format, common, ngram_join, ppm_score, quality_rules, source_mix, token_files, toxicity, url_filter

tokenizers = pytest.importorskip("public_tokenizers")
LONG = "wort " * 3000 + "x" * 1000
TEXTS = [None, "", " \n\t ", "one", "a b c\na b c\n", LONG, LONG, "Ünïcode　spaces\x1c x  y\n\n z", "the cat sat on the mat. " * 5, "the cat sat on the mat. " * 5, "don't <|endoftext|> I'LL 12 ²½"]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, toxic int, class int, row int, key int, block int, size int, word string, mark int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i // 2 if i in (8, 9) else i, t, "en", [None, "a", "b"][i % 3], 0, 1, 1, 1, 1, 1, 1, "w", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def labels(spark, rows=((2, 1), (4, None), (5, 0), (None, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


def each(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def test_quality(spark, docs, none):
    got = quality_rules.apply(docs).collect()
    assert len(got) == len(TEXTS) and quality_rules.apply(none).count() == 0 and quality_rules.keep(none).count() == 0
    for r, (i, t) in zip(got, each(docs), strict=True):
        w = words(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else set(grams[:1])
        covered = {k + j for k, g in enumerate(grams) if g in again for j in range(8)}
        assert (r.doc_id, r.n_words, r.n_symbols) == (i, len(w), sum(c in "#*$%&|<>" for c in t))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        if len(grams) < 500:
            assert r.n_repeat_words == len(covered)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert r.n_dup_lines == dup and r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and not (r.base_failed and r.kept)
    stay = {r.doc_id: r for r in quality_rules.keep(docs).collect()}
    assert quality_rules.keep(docs).columns == docs.columns and set(stay) == {r.doc_id for r in got if r.kept}
    for r in quality_rules.apply(docs, with_text=True).collect():
        if r.kept:
            assert (stay[r.doc_id].text, stay[r.doc_id].n_chars) == (r.clean_text, len(r.clean_text))


def test_quality_lines():
    rule = lambda s: quality_rules.judge_line(s.encode(), s.encode().split(), quality_rules.Rules())
    assert rule("Home | About | Contact | Login") == "navigation"
    assert rule("A line of prose, as it should be, that ends here.") is None
    assert rule("this%%% that*** other&&& more$$$ words### again") == "punctuation"
    assert rule("spam spam spam spam spam eggs") == "boilerplate"
    assert rule("All rights reserved.") == "boilerplate"
    assert rule("") is None and rule("La.") is None


def test_bpe(spark, docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = byte_bpe.digests(docs, path, tokenizers.PATTERN).collect()
    assert byte_bpe.digests(none, path, tokenizers.PATTERN).count() == 0
    for r, (i, t) in zip(got, each(docs), strict=True):
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert (r.doc_id, r.n_tokens) == (i, len(ids)) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    rng = np.random.default_rng(3)
    letters = ["  ", " ", "a", "B", "9", "é", "漢", "\n", "\t", "　", "'s", ".", "\x1c", "\x85", "the", "==", "\r\n"]
    odd = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    odd += ["".join(rng.choice(list(a), 390)) for a in ("abcdefghijklmnopqrstuvwxyz", "0123456789", "acgt", "ab", "=-") for _ in range(8)] + ["a" * 20000, "=" * 3001]
    own = byte_bpe.Codec(byte_bpe.read_ranks(path), tokenizers.PATTERN)
    ids, sizes = own.encode(odd)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(t) for t in odd]
    assert own.decode(ids, sizes) == [t.encode() for t in odd]
    encoded = byte_bpe.encode(docs, path, tokenizers.PATTERN)
    assert [bytes(r.decoded).decode() for r in byte_bpe.decode(encoded, path, tokenizers.PATTERN).collect()] == [t for _, t in each(docs)]


def test_bpe_marks_and_memory():
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.Codec(byte_bpe.read_ranks(path), tokenizers.PATTERN)
    pattern, cut = own.split, []

    class Counted:
        def findall(self, text):
            cut.append(text)
            return pattern.findall(text)

    own.split = Counted()
    texts = ["x wort*** Straße.,; über### naïve&&&", "x don't a1 wort's", "", "x漢字!?  y"]
    first = own.encode(texts)
    # letters and the marks after them are cut without the pattern
    assert sorted(filter(str.strip, cut)) == sorted(["x", " don't", " a1", " wort's", "x漢字!?", "  y"])
    for x in (own.tokens, own.units, own.runs):
        x.most = 0  # everything is forgotten after each call
    for _ in range(2):
        ids, sizes = own.encode(texts)
        assert (ids.tolist(), sizes.tolist()) == (first[0].tolist(), first[1].tolist())
        assert own.decode(ids, sizes) == [t.encode() for t in texts] and not len(own.tokens.keys)


def test_bpe_pieces_of_words():
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, query, rows = byte_bpe.Codec(ranks, tokenizers.PATTERN), byte_bpe.Codec.query, []

    def counted(sql, **tables):
        if sql == byte_bpe.CONTRACT:
            rows.append(len(tables["rows_in"]))
        return query(own, sql, **tables)

    own.query = counted
    rng = np.random.default_rng(5)
    parts = ["th", "on", "er", "ción", "keit", "ñ", "eau", "sh", "ndr", "lla", "öß", "tti"]
    texts = [" " + " ".join("".join(rng.choice(parts, rng.integers(2, 6))) for _ in range(2000)) for _ in range(3)]
    texts += ["aaaaaaa abababab" * 9, " thth" * 3, "漢字漢字 ((((((((x", "tion" * 400]
    for most in (own.pieces.most, 0):  # 0: everything is forgotten after each call
        own.pieces.most = own.tokens.most = most
        ids, sizes = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(t) for t in texts]
        own.encode([t[::-1] for t in texts])
    # what the first steps leave of words is much alike, and is contracted once
    assert sum(rows) < 0.6 * sum(map(len, {w.encode() for t in texts for w in t.split(" ")}))


def test_token_files(spark, docs, none, tmp_path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    for n, table in enumerate((docs, none)):
        path = str(tmp_path / f"ids{n}")
        token_files.write(table, tokenizers.path("word_bpe_49k.json"), 2, path)
        got = sorted(token_files.checksums(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got) and len(got) == table.count()
        want = sorted((i if i is not None else -1, (ids := library.encode(t, add_special_tokens=False).ids + [2]) and len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in each(table))
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == want
        start = 0
        for r in got:
            assert r.start == start
            start += r.n_tokens
    assert [r.doc_id for r in token_files.tokens(spark, str(tmp_path / "ids0"), 5, 6).collect()] == [5, 6]
    assert token_files.metadata(spark, str(tmp_path / "ids0")).count() == len(TEXTS)


def test_token_words(monkeypatch):
    pytest.importorskip("tokenizers")
    own, stem_of, asked = token_files.Encoder(tokenizers.path("word_bpe_49k.json")), token_files.stem_of, []
    monkeypatch.setattr(token_files, "stem_of", lambda w: asked.append(w) or stem_of(w))
    texts = [" The cat***, sat<|endoftext|>. %% a1! ", "", "x", "THE Straße. café! 漢字, ².\x1cİ?\x85 <|X.", "wort\u3000! ..", "the the. The"]
    for _ in range(2):
        assert own.check(texts)
        own.stems.most = 0  # everything is forgotten after each call
    # ASCII words are parted from their marks without Python
    assert asked and not any(w.isascii() for w in asked)


def test_shingles_hold_nothing():
    own, parts, texts = ngram_join.Shingles(4), ngram_join.Parts(ngram_join.Join()), ["a b c", "x", "", "The the THE the the", "a b c d e f a b c d e", LONG, "é\u3000É a\x1cb c d"]
    texts += [" ".join(f"w{(i * j) % 97}" for j in range(40 + i)) for i in range(20)]
    found = [own.of(t.encode()) for t in texts]
    assert list(vars(own).values()) == [4]  # words are hashed once a text and not remembered
    brute = []
    for t in texts:
        w = words("".join(c.lower() if c.isascii() else c for c in t))
        brute.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    for a, x in zip(found, brute, strict=True):
        assert len(a) == len(x) and (a[1:] > a[:-1]).all()
        assert [len(np.intersect1d(a, b)) for b in found] == [len(x & y) for y in brute]
        if len(a):  # one of each part, empty ones too
            made = parts.signatures(a)
            assert len(np.unique(made)) == len(made) == sum(parts.of(b)[0] for b in parts.bands(len(a)))


def test_mix(spark, docs, none):
    got = source_mix.amounts(docs).collect()
    assert len(got) == len(TEXTS) and source_mix.amounts(none).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sizes, targets = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        targets[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s))
    assert targets == pytest.approx(dict(zip(order, brute_targets([sizes[s] for s in order]), strict=True)))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mix.amounts(docs).collect()), key=repr)
    assert source_mix.mixed(docs).columns == docs.columns
    assert source_mix.mixed(none).count() == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    w = [weights[i % 3] for i in range(len(sizes))]
    left, full, out = 1.5 * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        if not over:
            return [share.get(i, 2.0 * sizes[i]) for i in range(len(sizes))]
        for i in over:
            full.add(i)
            left -= 2 * sizes[i]


def test_splitting_tree():
    quotas = np.array([7, 0, 100, 33])
    for shards in (1, 5, 8):
        leaves = [source_mix.shard_quotas(quotas, shards, 3, s) for s in range(shards)]
        assert (sum(n for _, n in leaves) == quotas).all()
        for i in range(len(quotas)):
            spans = sorted((int(f[i]), int(n[i])) for f, n in leaves if n[i])
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert max(n.sum() for _, n in leaves) - min(n.sum() for _, n in leaves) <= 3


def test_urls(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow")]
    urls = [None, "", "no", "http://A.Example.COM/en/7x?q", "https://com/en/", "x://b.com/en/8#t", "http://notcom/en/", "http://bad.org", "http://sub.bad.org/z", "http://bad.orgx/", "://", "http://a.com?/en/"]
    got = url_filter.apply(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, ["bad.org"]).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("com", "/en/", "com/en/", "block"),
        ("b.com", "/en/8", "com/en/", "block"), ("notcom", "/en/", None, "allow"), ("bad.org", "", None, "block"), ("sub.bad.org", "/z", None, "block"), ("bad.orgx", "/", None, "allow"),
        ("", "", None, "allow"), ("a.com", "", None, "allow"),
    ]
    assert url_filter.apply(spark.createDataFrame([], "page_id long, url string, host string"), rules).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "sub.bad.org/" + "x" * 100_000, 5, "z")], "page_id long, url string, rule int, host string")
    assert [(r.verdict, r.blocked_host, len(r.host)) for r in url_filter.apply(long, rules, ["bad.org"]).collect()] == [("block", "bad.org", 400_011)]


def test_ppm(spark, docs, none):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    got = ppm_score.scores(docs, lambda i: F.coalesce(i % 3 != 0, F.lit(True)), ppm_score.Ppm(order=3, frequent_words=2)).collect()
    rows = each(docs)
    bags = [words(t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [b""] for _, t in rows]
    count = Counter(w for (i, _), b in zip(rows, bags, strict=True) if i is None or i % 3 for w in b)
    n = sum(count.values())
    want = sorted((len(b), sum(count[w] > 0 for w in b), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in b), 6)) for b in bags)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got) and ppm_score.scores(none, lambda i: i > 0).count() == 0


def test_ppm_is_a_distribution():
    key, n = np.unique(ppm_score.grams([b"abracadabra", b"", b"banana " * 9], 3), return_counts=True)
    levels = []
    for j in range(4):
        k, at = np.unique(key & np.uint64((1 << (8 * (j + 1))) - 1), return_inverse=True)
        levels.append((k, np.bincount(at, weights=n).astype(np.int64)))
    model = ppm_score.Model(levels)
    for context in (b"abr", b"\0\0\0", b"zzz", b"zna", b"an "):
        c = np.uint64(int.from_bytes(context, "big"))
        assert (10 ** model.log10((c << np.uint64(8)) | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)
    assert ppm_score.Model([(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 3).score([b"a"])[0] == pytest.approx(-2 * np.log10(256))


@pytest.mark.parametrize(("size", "part_keys"), [(30_000, 1_000), (2_600_000, 200_000)])
def test_ppm_whole_trie(spark, size, part_keys):
    """Every key counts, also those beyond the 2,000,000 that a level was once cut to."""
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .", np.uint8)
    texts = [rng.choice(letters, size // 100).tobytes().decode() for _ in range(100)] + ["abc abd abe", "", "zz"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in ppm_score.scores(table, lambda i: i % 10 != 3, ppm_score.Ppm(part_keys=part_keys)).collect()}
    keys, counts = np.unique(ppm_score.grams([t.encode() for i, t in enumerate(texts) if i % 10 != 3], 5), return_counts=True)
    assert size < 1_000_000 or len(keys) > 2_000_000
    model = ppm_score.Model(ppm_score.levels_of(keys, counts, range(6)))
    want = model.score([t.encode() for t in texts])
    assert len(got) == len(texts) and [got[i] for i in range(len(texts))] == pytest.approx(list(want), rel=1e-9)


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(vocabulary, 30))
        rows.append((i, text + (" you moron" if i % 4 == 0 else ""), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = toxicity.fit(toxicity.training_rows(table.select("doc_id", "text"), table.select("doc_id", "toxic"), lambda i: ~toxicity.held_out(i)))
    got = {r.doc_id: r for r in toxicity.score(table, fitted).collect()}
    assert all((got[i].score >= 0.5) == bool(y) and 0 <= got[i].score <= 1 for i, _, y in rows)
    assert toxicity.keep(docs, fitted).columns == docs.columns and toxicity.score(none, fitted).count() == 0
    assert toxicity.score(docs, fitted).count() == len(TEXTS)
    nothing = toxicity.fit(toxicity.training_rows(docs, labels(spark, ()), lambda i: i > 0))
    assert nothing is None and {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    few = toxicity.fit(toxicity.training_rows(docs, labels(spark), lambda i: i >= 0))
    assert toxicity.score(docs, few).count() == len(TEXTS)


@pytest.mark.parametrize("common", [0, 30])
def test_block_max_index(common):
    """Against all products, with features of few examples alone and with some that most examples have."""
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        f = np.concatenate([rng.choice(400, 4, replace=False), 400 + rng.choice(40, common, replace=False)])
        w = rng.random(len(f)) * np.where(f < 400, 1, 0.2)
        vectors.append((f, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 440, 16)
    assert index.long.any() == bool(common)
    dense = np.zeros((500, 440))
    for i, (f, w) in enumerate(vectors):
        dense[i, f] = w
    for i in range(60):
        near = dense @ dense[i]
        brute = [j for j in np.lexsort((np.arange(500), -near)).tolist() if near[j] > 0 and j != i][:7]
        got = index.search(vectors[i], 7, skip=i)
        assert [s for s, _ in got] == pytest.approx([near[j] for j in brute]) and all(near[j] == pytest.approx(s) for s, j in got)


@pytest.mark.parametrize("frequent", [0, 30])
def test_nearest_of_a_batch(frequent):
    """A batch's dense products against whole ones: ties, tiny weights, few near examples, none; the index survives pickling small."""
    rng = np.random.default_rng(2)
    vectors = []
    for i in range(700):
        f = np.concatenate([rng.choice(400, 4, replace=False), 400 + rng.choice(40, frequent, replace=False)])
        w = rng.random(len(f)) * np.where(f < 400, 1, 0.2) * (1e-60 if i % 9 == 0 else 1) ** (f % 2)
        vectors.append((f, w / np.linalg.norm(w)) if i % 7 else (np.array([7, 8]), np.array([0.6, 0.8])))
    vectors.append((np.array([440]), np.array([1.0])))
    built = toxicity.BlockMaxIndex(vectors, 442, 16)
    held = pickle.dumps(built)
    index = pickle.loads(held)
    assert len(held) < 13 * sum(len(f) for f, _ in vectors) + 8_000  # a feature and its weight, once
    dense = np.zeros((len(vectors), 442))
    for i, (f, w) in enumerate(vectors):
        dense[i, f] = w
    asked = [*vectors, (np.zeros(0, int), np.zeros(0)), (np.array([441]), np.array([1.0]))]
    found, left_out = index.nearest(asked, 7), index.nearest(vectors, 7, skip=0)
    assert index.dense.shape[0] and len(found) == len(asked) and found[-2:] == [[], []] and len(found[700]) == 1 and left_out[700] == []
    for i in range(len(vectors)):
        near = dense @ dense[i]
        for got, others in ((found[i], range(701)), (left_out[i], [j for j in range(701) if j != i])):
            brute = sorted((j for j in others if near[j] > 0), key=lambda j: -near[j])[:7]
            assert [s for s, _ in got] == pytest.approx([near[j] for j in brute], rel=1e-9) and all(near[j] == pytest.approx(s, rel=1e-9) for s, j in got)
            assert all(a < b for (s, a), (t, b) in zip(got, got[1:]) if s == t)


def test_ngram(spark, docs, none):
    got = ngram_join.groups(docs).collect()
    assert len(got) == len(TEXTS) and ngram_join.groups(none).count() == 0
    by = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in got)
    assert (5, 999 and by[[b[0] for b in by].index(5)][1], 5) in by and [b[2] for b in by if b[0] == 6] == [5]
    assert [b[1:] for b in by if b[0] == 0] == [(0, 0)]
    assert ngram_join.keep_one(docs).columns and ngram_join.keep_one(none).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_against_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 60))
    made = []
    for i in range(160):
        n = int(rng.integers(1, 90))
        base = list(rng.choice(vocabulary, n)) if i % 3 or not made else list(made[int(rng.integers(len(made)))])
        for j in rng.integers(0, len(base), int(rng.integers(0, 3))):
            base[j] = str(rng.choice(vocabulary))
        made.append(base + passage * (i % 5 == 0 and len(base) < 90))
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for w in made]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    for few, twos in ((1, 100), (4, 100), (1, 0), (2, 6)):
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.groups(frame, ngram_join.Join(words=k, percent=percent, few=few, twos=twos, block_docs=8)).collect()}
        assert got == {i: (find(i), len(s)) for i, s in enumerate(sets)}


def test_tasks_give_memory_back():
    """What a task has freed goes back to the system when it ends, so a worker doesn't carry it into the next stage."""
    import pyarrow as pa

    from verifold.llm import common

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) >> 10

    kept = []

    def task(batches):
        for batch in batches:
            blocks = [bytes(60_000) + b"x" for _ in range(5_000)]  # 300 MB, below the size that is mapped by itself
            kept.append(blocks[-1])  # stands behind them
            yield batch

    batch = pa.record_batch([pa.array([1])], names=["a"])
    common.trim()
    before = held()
    assert list(common.trimmed(task)(iter([batch]))) == [batch]
    assert held() - before < 100


def test_ngram_cuts_chains(spark, monkeypatch):
    """A cluster that only candidates hold together isn't multiplied block by block, which copies every set once a block."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 100)) + " " + passage for _ in range(60)]
    texts += [t.replace("w", "near", 1) for t in texts[:5]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, links = [], ngram_join.links

    def chained(docs, join):
        nodes = ngram_join.described(docs, join).select("class")
        return nodes.crossJoin(nodes.agg(F.min("class").alias("a"))).select("a", F.col("class").alias("b"))

    def measured(docs, classes, clusters, join):
        sizes.extend(r["count"] for r in clusters.groupBy("root").count().collect())
        return links(docs, classes, clusters, join)

    monkeypatch.setattr(ngram_join, "candidates", chained)
    monkeypatch.setattr(ngram_join, "links", measured)
    got = {r.doc_id: r.component_id for r in ngram_join.groups(frame, ngram_join.Join(block_docs=8)).collect()}
    assert got == {i: i if i < 60 else i - 60 for i in range(65)}
    assert max(sizes) == 2


def test_chat(spark):
    import itertools

    costs = chat_format.Costs()

    def brute(roles):
        best = chat_format.FAR
        for path in itertools.product((1, 2, 3), repeat=len(roles)):
            state, total = 0, 0
            for role, to in zip(roles, path, strict=True):
                total += costs.steps()[role, state, to]
                state = to
            best = min(best, total + (costs.insert if state == 1 else 0))
        return best

    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            assert chat_format.solve(list(roles), costs)[0] == brute(roles)
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "Assistant ", None), (2, 5, None, "x"), (None, None, "system", ""), (3, 1, "bot", "hi"), (3, 1, "bot", "hi")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(400)]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, run int, cut_id string")
    got = chat_format.apply(table).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)
    assert "".join(r.rendered for r in one) == "<|user|>\na\n\nb\n<|assistant|>\n" and [r.action for r in one] == ["keep", "merge", "keep"]
    long = sorted((r for r in got if r.conv_id == 9), key=lambda r: r.turn)
    assert len(long) == 400 and all(r.action == "keep" for r in long)
    assert [(r.role, r.action) for r in got if r.conv_id is None] == [("user", "relabel")]  # cheaper than an empty user turn
    assert chat_format.apply(table.limit(0)).count() == 0


def test_driver_gives_memory_back(spark):
    """What a step took in the driver's Python is the system's again when the next table is written."""
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    held = [(str(i) * 200).encode() for i in range(150_000)]
    kept = held[::500]  # stand between, so that the C library does not shrink its heap by itself
    before = resident()
    del held
    common.materialize(spark.range(3), "three")
    assert kept and resident() < before - (60 << 20)
