import hashlib
import math

import pytest

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, weight double, size long, _source string, epochs double"


def made(spark, rows):
    return spark.createDataFrame([(d, t, s, 0.5, 1, "z", 9.0) for d, t, s in rows], SCHEMA)


def filled(sizes, weights, budget, most):
    """Clamp, redistribute, repeat until feasible."""
    given, free, left = {}, {s for s in sizes if weights[s] > 0}, budget
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total >= most * sizes[s]}
        if not over:
            given |= {s: max(0, left * weights[s] / total) for s in free}
            break
        for s in over:
            given[s] = most * sizes[s]
        left -= sum(given[s] for s in over)
        free -= over
    return {s: given.get(s, 0.0) for s in sizes}


CASES = [({"a": 1000, "b": 10, "c": 5}, {"a": 1, "b": 1, "c": 1}, None, 4.0), ({"a": 100, "b": 100}, {"a": 3, "b": 1}, None, 1.2), ({"a": 10, "b": 10}, {"a": 1, "b": 0}, 50, 4.0), ({"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 2, "c": 3}, 10_000, 2.0), ({"a": 7}, {"a": 1}, None, 4.0)]


@pytest.mark.parametrize(("sizes", "weights", "budget", "most"), CASES)
def test_water_filling(spark, sizes, weights, budget, most):
    rows = [(k, "x" * n, s) for k, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["given"] for r in mixing.allocation(made(spark, rows), weights, budget, most).collect()}
    assert got == pytest.approx(filled(sizes, weights, budget or sum(sizes.values()), most))


def times(doc, epochs, seed=mixing.SEED):
    u = int(hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:12], 16) / 2**48
    return math.floor(epochs) + (u < epochs - math.floor(epochs))


ROWS = [(k, "word " * (k % 7 + 1), "ab"[k % 5 == 0]) for k in range(200)] + [(None, "no number", "a"), (500, None, None), (501, "", None), (502, "z" * 1_000_000, "big"), (0, "word ", "b"), (0, "word ", "b")]


def test_sample_against_brute_force(spark):
    df = made(spark, ROWS)
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + max(1, len(t or "x"))
    shares = filled(sizes, {s: n**0.5 for s, n in sizes.items()}, sum(sizes.values()), 4.0)
    want = []
    for d, t, s in ROWS:
        key = d if d is not None else "t" + hashlib.md5((t or "").encode()).hexdigest()
        want += [(str(d), str(s), k + 1) for k in range(times(key, shares[s] / sizes[s]))]
    assert sorted((str(r["doc_id"]), str(r["source"]), r["copy"]) for r in mixing.sampled(df).collect()) == sorted(want)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(x[0] for x in want)
    assert {r["_source"] for r in out.collect()} == {"z"}


def test_expected_shares(spark):
    rows = [(k, "x" * 10, "a" if k % 4 else "b") for k in range(4000)]
    n = {r["source"]: r["count"] for r in mixing.sampled(made(spark, rows), {"a": 1, "b": 1}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(2000, rel=0.06) and n["b"] == pytest.approx(2000, rel=0.06)


def test_empty(spark):
    assert mixing.sampled(made(spark, [])).collect() == [] and mixing.mixed(made(spark, [])).collect() == []
