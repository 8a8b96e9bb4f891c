import numpy as np
import pytest

from tessera.llm import ann

SCHEMA = "vec_id long, embedding array<float>, id string, list int, distance double"


def made(spark, rows):
    return spark.createDataFrame([(k, v, "i", 1, 2.0) for k, v in rows], SCHEMA)


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    return {i: {ids[j] for j in np.lexsort((ids, row))[:k]} for i, row in zip(ids, d)}


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], set()).add(r["neighbour"])
    return np.mean([len(by.get(i, set()) & w) / len(w) for i, w in want.items()])


def test_recall_on_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = rows.orderBy("vec_id").collect()
    want = brute(np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], np.float64), 10)
    got = ann.neighbours(rows).collect()
    assert recall(got, want) >= 0.9
    assert len(got) == 10 * len(data)
    assert all(sorted(r["rank"] for r in got if r["vec_id"] == i) == list(range(1, 11)) for i in list(want)[:20])


def clustered(n, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(12, 24))[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, 24))).astype(np.float32)


@pytest.mark.parametrize("group", [20_000, 500])
def test_recall_of_many_lists(spark, group, monkeypatch):
    x = clustered(3000)
    df = made(spark, [(int(k), v.tolist()) for k, v in enumerate(x)])
    graph = ann.build_graph(ann.prepared(df), list_size=16, group=group)
    assert len(graph.centroids) >= 3000 / 16
    got = ann.neighbours(df, k=5, list_size=16).collect()
    assert recall(got, brute(np.arange(3000), x.astype(float), 5)) >= 0.9


def test_lists_are_balanced():
    parts = ann.bisected(clustered(1000), 50)
    assert sorted(np.concatenate(parts)) == list(range(1000)) and max(map(len, parts)) <= 50 and min(map(len, parts)) >= 25
    assert max(map(len, ann.bisected(np.ones((100, 3), np.float32), 10))) <= 10


def test_centroids_keep_to_their_bytes(spark):
    df = made(spark, [(int(k), v.tolist()) for k, v in enumerate(clustered(2000))])
    graph = ann.build_graph(ann.prepared(df), list_size=8, centroid_bytes=20_000)
    assert len(graph.centroids) * (24 * 4 + ann.DEGREE * 4) <= 20_000


def test_odd_rows(spark):
    v = clustered(60)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(None, v[0].tolist()), (100, None), (101, []), (102, [0.0] * 24), (103, [float("nan")] * 24), (104, [1.0] * 3), (0, v[0].tolist()), (105, v[1].tolist()), (106, (2 * v[1]).tolist())]
    got = ann.neighbours(made(spark, rows), k=3).collect()
    assert {r["vec_id"] for r in got} == {*range(60), 105, 106} and len(got) == 62 * 3
    ones = {r["neighbour"] for r in got if r["vec_id"] == 1 and r["rank"] <= 2}
    assert ones == {105, 106} and all(abs(r["distance"]) < 1e-6 for r in got if r["vec_id"] == 1 and r["rank"] <= 2)


def test_few_rows(spark):
    assert ann.neighbours(made(spark, [])).collect() == []
    assert ann.neighbours(made(spark, [(1, [1.0, 0.0])])).collect() == []
    assert {(r["vec_id"], r["neighbour"], r["rank"]) for r in ann.neighbours(made(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])).collect()} == {(1, 2, 1), (2, 1, 1)}


def test_recall_without_structure(spark):
    x = np.random.default_rng(3).normal(size=(20_000, 64)).astype(np.float32)
    schema = "vec_id long, embedding array<float>"
    got = ann.neighbours(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], schema)).where("vec_id < 300").collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x[:300] @ x.T
    d[np.arange(300), np.arange(300)] = np.inf
    assert recall(got, {i: set(np.argsort(d[i])[:10].tolist()) for i in range(300)}) >= 0.9


def test_every_tight_cluster_has_an_entry():
    rng = np.random.default_rng(5)
    c = (rng.normal(size=(120, 1, 32)) + 0.02 * rng.normal(size=(120, 40, 32))).reshape(-1, 32).astype(np.float32)
    d = ((c * c).sum(1) / 2) - c @ c.T
    np.fill_diagonal(d, np.inf)
    edges = np.vstack((np.argsort(d, 1)[:, :24], np.full((1, 24), -1)))
    order = rng.permutation(len(c))
    back = np.argsort(order)
    graph = ann.Graph(c[order], np.vstack((back[edges[order]], edges[-1:])))
    ids, _ = graph.search(c + 0.001, 16)
    assert (order[ids[:, 0]] // 40 == np.arange(len(c)) // 40).mean() > 0.99
