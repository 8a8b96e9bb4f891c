"""Token ids as length-delimited binary records.

A file is a sequence of frames: the payload's length (8 bytes, little endian), its masked CRC-32C (4 bytes), the payload,
the payload's masked CRC-32C (4 bytes): the framing of TFRecord files, which their readers can read. A payload is one byte
for the width of an id (2 or 4), one that is 1 if there is a doc_id, the doc_id (8 bytes, signed) and the ids.

The offset index is a Parquet table beside the files, one row for each record. Records can thus be read in any order. A
task writes files under names of its own attempt and the index is written by Spark's commit protocol from the rows of the
attempts that count: a lost, repeated or speculative attempt leaves a file that no index row names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ranges, releasing, scratch_path, small_batches
from tessera.llm.tokens import VOCABULARY, Tokenizer, valid

FILE_BYTES = 128 << 20
CHUNK = 64
INDEX = "doc_id long, file string, record long, offset long, payload_bytes long, tokens long, checksum long"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte of CRC-32C, and for each k four tables that shift a checksum by 2^k zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1).astype(np.uint32)
    shifts = np.zeros((40, 4, 256), np.uint32)
    for b in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
        shifts[0, b] = one[v & 255] ^ (v >> np.uint32(8))
    for k in range(1, 40):
        for b in range(4):
            shifts[k, b] = _shift(shifts[k - 1], shifts[k - 1, b])
    return one, shifts


def _shift(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][(v >> np.uint32(8)) & 255] ^ table[2][(v >> np.uint32(16)) & 255] ^ table[3][v >> np.uint32(24)]


_ONE, _SHIFTS = _tables()


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of data[offsets[k]:offsets[k + 1]] for each k, as uint32.

    All chunks of 64 bytes are stepped through together; a checksum is linear, so neighbouring chunks are then joined in
    pairs, in log2(chunks) rounds. Zeros before a message don't change its checksum, which fills first chunks.
    """
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK)
    total = int(chunks.sum())
    lanes = np.zeros((CHUNK, total), np.uint8)
    if len(data):
        ends = np.cumsum(chunks)
        place = np.arange(len(data)) - np.repeat(offsets[1:], lengths)  # from a record's end, below 0
        back = -1 - place
        lane = np.repeat(ends, lengths) - 1 - back // CHUNK
        lanes[CHUNK - 1 - back % CHUNK, lane] = data
    crc = np.zeros(total, np.uint32)
    for t in range(CHUNK):
        crc = _ONE[(crc ^ lanes[t]) & 255] ^ (crc >> np.uint32(8))
    many, level = chunks.copy(), 6
    while len(many) and many.max() > 1:
        ends = np.cumsum(many)
        half = -(-many // 2)
        k = ranges(np.zeros(len(many), np.int64), half)
        last = np.repeat(ends, half) - 1 - 2 * (np.repeat(half, half) - 1 - k)
        has = last - 1 >= np.repeat(ends - many, half)
        joined = crc[last].copy()
        joined[has] ^= _shift(_SHIFTS[level], crc[last[has] - 1])
        crc, many, level = joined, half, level + 1
    out = np.zeros(len(lengths), np.uint32)
    out[chunks > 0] = crc
    start = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        on = (lengths >> k) & 1 == 1
        start[on] = _shift(_SHIFTS[k], start[on])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def framed(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The frames of payloads, and the payloads' masked checksums."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    heads = masked(crc32c(np.frombuffer(sizes.astype("<u8").tobytes(), np.uint8), np.arange(len(sizes) + 1) * 8))
    sums = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), np.concatenate(([0], np.cumsum(sizes)))))
    return [struct.pack("<QI", n, h) + p + struct.pack("<I", s) for n, h, p, s in zip(sizes.tolist(), heads.tolist(), payloads, sums.tolist())], sums


def payload(doc_id: int | None, ids: list[int], width: int) -> bytes:
    return struct.pack("<BBq", width, doc_id is not None, doc_id or 0) + np.array(ids, f"<u{width}").tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    width, has, doc_id = struct.unpack_from("<BBq", data)
    return doc_id if has else None, np.frombuffer(data, f"<u{width}", offset=10)


def write_records(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of docs to files below path, and their index to path/_index; returns the index.

    A null or empty text is a record of no ids; null and repeated doc_ids are records as any other; an empty table has an
    empty index and no files. Other columns than doc_id and text are ignored. A file is closed once it has file_bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = Tokenizer(spark, vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if len(tokenizer.byte_lengths()) <= 1 << 16 else 4
        system, root = fs.FileSystem.from_uri(path)
        attempt = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        system.create_dir(root, recursive=True)
        out, name, at, number, files = None, "", 0, 0, 0
        try:
            for batch in batches:
                docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                ids = [tokenizer.encode(valid(x)) for x in texts]
                frames, sums = framed([payload(d, x, width) for d, x in zip(docs_, ids)])
                rows = []
                for d, x, f, s in zip(docs_, ids, frames, sums.tolist()):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at, number = f"records-{attempt}-{files:04d}.bin", 0, 0
                        out = system.open_output_stream(f"{root}/{name}")
                        files += 1
                    out.write(f)
                    rows.append((d, name, number, at, len(f) - 16, len(x), s))
                    at += len(f)
                    number += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*rows))], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(write), INDEX)
    rows.write.parquet(f"{path}/_index")
    return spark.read.schema(INDEX).parquet(f"{path}/_index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of the records that the rows of an index name, in its partitions and order; checksums are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        files: dict[str, object] = {}
        for batch in batches:
            docs, ids, raw = [], [], []
            for name, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "payload_bytes"))):
                if name not in files:
                    files[name] = system.open_input_file(f"{root}/{name}")
                raw.append(files[name].read_at(size + 16, offset))
            again, _ = framed([x[12:-4] for x in raw])
            for a, x in zip(again, raw):
                if a != x:
                    raise ValueError("a record's length or checksum doesn't match")
                d, v = parsed(x[12:-4])
                docs.append(d), ids.append(v.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return index.select("file", "offset", "payload_bytes").mapInArrow(read, "doc_id long, ids array<int>")


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """write_records to a new folder in the shared scratch folder; the index with the folder in the column `folder`."""
    path = scratch_path(docs.sparkSession, "records")
    return write_records(docs, path, vocabulary).withColumn("folder", F.lit(path))
