import itertools
import random

import pytest

from tessera.llm import packing
from tessera.llm.tokens import Tokenizer

SCHEMA = "doc_id long, text string, length long, bucket int, n long, h string, slice int"


def padding(histogram, lengths):
    return sum(n * (min(b for b in lengths if b >= k) - k) for k, n in histogram.items())


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_against_all_choices(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 60): rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))}
    for buckets in range(1, 5):
        got = packing.boundaries(histogram, buckets)
        assert len(got) <= buckets and got[-1] == max(histogram)
        best = min(padding(histogram, {*c, max(histogram)}) for n in range(min(buckets, len(histogram))) for c in itertools.combinations(histogram, n))
        assert padding(histogram, got) == best
    assert packing.boundaries({}, 3) == []


def made(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, "h", 4) for d, t in rows], SCHEMA)


def test_packed(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["word"] * rng.choice([1, 3, 17, 60, 200]))) for k in range(300)] + [(0, "twice"), (0, "twice"), (None, "no number"), (700, None), (701, ""), (702, "long " * 30_000)]
    out = packing.packed(made(spark, rows), max_len=64, buckets=4, budget=256).collect()
    tok = Tokenizer(spark)
    want = []
    for d, t in rows:
        n = len(tok.encode(t or ""))
        want += [(str(d), p, p * 64, min(64, n - p * 64)) for p in range(-(-n // 64))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"]) for r in out) == sorted(want)
    histogram = {}
    for w in want:
        histogram[w[3]] = histogram.get(w[3], 0) + 1
    lengths = packing.boundaries(histogram, 4)
    assert all(r["bucket"] == min(b for b in lengths if b >= r["length"]) for r in out)
    batches = {}
    for r in out:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in batches.values())
    for b in lengths:
        mine = sorted(k for k in batches if k[0] == b)
        assert [k[1] for k in mine] == list(range(len(mine)))
        assert all(len(batches[k]) == 256 // b for k in mine[:-1]) and len(batches[mine[-1]]) <= 256 // b


def test_slices_make_one_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 10)
    rows = [(k, "some words") for k in range(95)]
    out = packing.packed(made(spark, rows), max_len=64, buckets=2, budget=64).collect()
    assert sorted((r["batch"], r["slot"]) for r in out) == [(k // 32, k % 32) for k in range(95)]


def test_copies_are_packed_apart(spark):
    """Repetitions that follow each other, as mixing leaves them, are spread like any other sequences."""
    rows = [(k, f"some words {k}") for k in range(300) for _ in range(3)]
    out = packing.packed(made(spark, rows), max_len=16, buckets=1, budget=64).collect()
    batches = {}
    for r in out:
        batches.setdefault(r["batch"], []).append(r["doc_id"])
    assert len(out) == 900
    together = sum(len(b) - len(set(b)) for b in batches.values())
    assert together < 30, "nine are expected by chance"


def test_rows_without_doc_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 10)
    out = packing.packed(made(spark, [(None, "some words")] * 200), max_len=64, buckets=1, budget=64)
    assert sorted((r["batch"], r["slot"]) for r in out.collect()) == [(k // 32, k % 32) for k in range(200)]
    copies = packing.sequences(made(spark, [(None, "some words")] * 200)).select("copy").distinct().count()
    assert copies == 200


def test_empty(spark):
    assert packing.packed(made(spark, [])).collect() == [] and packing.packed(made(spark, [(1, None)])).collect() == []
    with pytest.raises(ValueError):
        packing.packed(made(spark, []), max_len=64, budget=10)
