import numpy as np
import pytest

from verifold.llm import common, embed_dedup
from verifold.llm.components import components


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000), (None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows", [1024, 7])
def test_embeddings(spark, rows):
    rng = np.random.default_rng(3)
    made = []
    for i in range(240):
        v = rng.standard_normal(24) if i % 4 == 0 else np.array(made[-1][1]) + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.2])
        made.append((i, v.astype(np.float32).tolist(), int(i // 40 % 3)))
    made += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [None] * 24, 1), (1004, [float("nan")] * 24, 1), (1005, made[0][1], None), (None, made[0][1], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(*r, 0) for r in made], "vec_id long, embedding array<float>, label int, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.groups(frame, embed_dedup.Dedup(block_rows=rows)).collect()}
    x = np.array([v for _, v, _ in made[:240]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([y for *_, y in made[:240]])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(240)
    while True:
        new = np.minimum(root, np.where(link, root[None, :], 999).min(1))
        if (new == root).all():
            break
        root = new
    for i in range(240):
        assert got[i] == (link[i].sum(), root[i], root[i] == i)
    assert all(got[i] == (0, i, True) for i in range(1000, 1006)) and got[1006][:2] == (1, 1006) and got[1007][1] == 1006
    assert embed_dedup.groups(frame.limit(0)).count() == 0


def test_scratch(spark):
    kept = common.materialize(spark.range(5).withColumnRenamed("id", "x"), "probe")
    assert kept.count() == 5
    common.discard(kept)
    with pytest.raises(Exception, match="."):
        spark.read.parquet(kept.inputFiles()[0]).count()
