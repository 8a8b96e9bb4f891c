import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import records
from tessera.llm.tokens import Tokenizer

SCHEMA = "doc_id long, text string, file string, offset long, tokens string"


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc():
    assert slow_crc(b"123456789") == 0xE3069283
    rng = random.Random(2)
    data = [b"", b"123456789", b"\0" * 100, *(rng.randbytes(n) for n in (1, 63, 64, 65, 127, 128, 129, 1000, 8191))]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    got = records.crc32c(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got.tolist() == [slow_crc(d) for d in data]
    assert records.crc32c(np.zeros(0, np.uint8), np.zeros(1, np.int64)).tolist() == []


def made(spark, rows):
    return spark.createDataFrame([(d, t, "f", 1, "t") for d, t in rows], SCHEMA)


ROWS = [(k, f"text number {k} " * (k % 30)) for k in range(200)] + [(None, "no number"), (3, "again"), (3, "again"), (900, None), (901, ""), (902, "long text " * 100_000), (-5, "ünï 🎉")]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    index = records.write_records(made(spark, ROWS), path, file_bytes=4000)
    tok = Tokenizer(spark)
    want = sorted((str(d), tuple(tok.encode(t or ""))) for d, t in ROWS)
    shuffled = index.orderBy(F.xxhash64("offset", "file"))
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in records.read_records(shuffled, path).collect()) == want
    assert index.select("file").distinct().count() > 4
    rows = index.where("tokens > 0").orderBy("file", "record").collect()
    assert sorted(str(r["doc_id"]) for r in index.collect()) == sorted(str(d) for d, _ in ROWS)
    for r in rows[:40]:  # frame by frame, as any reader of the framing does
        with open(f"{tmp_path}/records/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            head = f.read(12)
            size, crc = struct.unpack("<QI", head)
            data = f.read(size)
            (total,) = struct.unpack("<I", f.read(4))
        mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
        assert size == r["payload_bytes"] and crc == mask(slow_crc(head[:8]))
        if size < 3000:
            assert total == mask(slow_crc(data)) == r["checksum"]


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    index = records.write_records(made(spark, ROWS[1:3]), path)
    r = index.first()
    with open(f"{tmp_path}/records/{r['file']}", "r+b") as f:
        f.seek(r["offset"] + 14)
        f.write(b"\xff")
    with pytest.raises(Exception, match="doesn't match"):
        records.read_records(index, path).collect()


def test_empty(spark, tmp_path):
    index = records.write_records(made(spark, []), f"file://{tmp_path}/records")
    assert index.collect() == []
