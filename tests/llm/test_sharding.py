import hashlib
import math

import pytest

from tessera.llm import sharding

SCHEMA = "doc_id long, text string, key string, shard string, name long"


def made(spark, rows):
    return spark.createDataFrame([(d, t, "k", "s", 1) for d, t in rows], SCHEMA)


def winner(key, shards):
    def score(name):
        u = (int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return shards[name] / -math.log(u)

    return max(sorted(shards), key=score)


ROWS = [(k, "text") for k in range(3000)] + [(None, "a"), (None, None), (None, ""), (0, "again"), (5000, "x" * 1_000_000), (-7, "y")]


def test_against_brute_force(spark):
    got = sharding.sharded(made(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    key = lambda d, t: str(d) if d is not None else "t" + hashlib.md5((t or "").encode()).hexdigest()
    want = sorted((str(d), key(d, t), winner(key(d, t), sharding.SHARDS)) for d, t in ROWS)
    assert sorted((str(r["doc_id"]), r["key"], r["shard"]) for r in got) == want


def test_shares_and_moves(spark):
    before = {f"s{k}": 1.0 + (k == 0) for k in range(5)}
    a = {r["doc_id"]: r["shard"] for r in sharding.sharded(made(spark, ROWS[:3000]), before).collect()}
    n = {s: sum(v == s for v in a.values()) for s in before}
    assert n["s0"] == pytest.approx(1000, rel=0.12) and all(n[s] == pytest.approx(500, rel=0.18) for s in before if s != "s0")
    more = {r["doc_id"]: r["shard"] for r in sharding.sharded(made(spark, ROWS[:3000]), before | {"s5": 1.0}).collect()}
    moved = {k for k in a if a[k] != more[k]}
    assert all(more[k] == "s5" for k in moved) and len(moved) == pytest.approx(3000 / 7, rel=0.2)
    less = {r["doc_id"]: r["shard"] for r in sharding.sharded(made(spark, ROWS[:3000]), {s: w for s, w in before.items() if s != "s3"}).collect()}
    assert all(a[k] == "s3" for k in a if a[k] != less[k])


def test_empty_and_bad_shards(spark):
    assert sharding.sharded(made(spark, [])).collect() == []
    for bad in ({}, {"a": 0.0}, {"a": math.inf}):
        with pytest.raises(ValueError):
            sharding.sharded(made(spark, []), bad)


def test_write(spark, tmp_path):
    df = made(spark, ROWS)
    name = sharding.write_shards(df, str(tmp_path / "out"), {"a": 1.0, "b": 2.0}, files=2)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and sorted(out.columns) == sorted([*df.columns, name])
    rows = out.collect()
    assert sorted(str(tuple(r[c] for c in df.columns)) for r in rows) == sorted(str(tuple(r)) for r in df.collect())
    key = lambda d, t: str(d) if d is not None else "t" + hashlib.md5((t or "").encode()).hexdigest()
    assert all(r["_shard"] == winner(key(r["doc_id"], r["text"]), {"a": 1.0, "b": 2.0}) for r in rows)
    assert sharding.write_shards(df.drop("shard"), str(tmp_path / "plain"), {"a": 1.0}) == "shard"
