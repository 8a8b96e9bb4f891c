"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Each token's span of characters follows from its bytes' lengths, and spans are
joined by interval to the document's sections; a document's tokens and sections are in one row, so nothing is shuffled.
A token whose span crosses section boundaries is allocated by a rule:

- "start": to the section that holds its first character in any section,
- "majority": to the section that holds most of its characters; the earlier one on a tie,
- "split": to all of them, by their shares of its characters within sections.

A token that holds part of a character only covers that character. Tokens outside all sections count for none.

The tokenizer's pattern can't match very long runs of white space. It makes of such a run one piece, all of it but the last
character if another character follows, so long runs are cut out there and merged as the one piece that they are: the
tokens are those of the whole text, whatever its length.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import releasing, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "majority", "split")
#: White space as the pattern sees it, in runs that are worth cutting out.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@functools.cache
def _encoding(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for token, k in table.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lengths


class Tokenizer:
    """The vocabulary file at a path that the driver can read; executors get its bytes, of fixed size, by broadcast."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            self.ranks = spark.sparkContext.broadcast(f.read())

    def encode(self, text: str) -> list[int]:
        e = _encoding(self.ranks.value)[0]
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text) if len(text) >= 1000 else ():
            a, z = run.span()
            z -= z < len(text)  # the last one goes with what follows
            out += e.encode_ordinary(text[at:a])
            out += e._encode_single_piece(text[a:z])
            at = z
        return out + e.encode_ordinary(text[at:]) if at else e.encode_ordinary(text)

    def byte_lengths(self) -> np.ndarray:
        return _encoding(self.ranks.value)[1]


def valid(text: str | None) -> str:
    """text with lone surrogates, which have no UTF-8 form, replaced; null is empty."""
    return "" if text is None else text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text


def token_counts(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, n, copy): the number of tokens of each row's text; 0 for null. Each text is encoded once, whatever is done with n.

    copy is 0 for the first row of a doc_id in a task; further ones and rows with null doc_id have numbers that no other row
    with that doc_id has in any task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {None: 1}
        task = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n = [len(tokenizer.encode(valid(x))) for x in batch.column("text").to_pylist()]
            copies = []
            for d in ids:
                k = seen.get(d, 0)
                copies.append(task + k if k else 0)
                seen[d] = k + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(copies, pa.int64())], names=["doc_id", "n", "copy"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("copy", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(releasing(count), schema)


def spans(ids: list[int], byte_lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token and the one after its last."""
    ends = np.cumsum(byte_lengths[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
    if raw.isascii():
        return np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends, ends
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(begins)))
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    return before[starts] - ~begins[np.minimum(starts, len(raw) - 1)], before[ends]


def allocate(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by section (whole numbers but for "split"), and how many of the tokens that touch it cross its boundary.

    Sections are [start, end), in order and disjoint; empty ones hold no token.
    """
    total, crossing = np.zeros(len(start)), np.zeros(len(start), np.int64)
    full = np.flatnonzero(end > start)
    if not len(full) or not len(first):
        return total, crossing
    s, e = start[full], end[full]
    a = np.searchsorted(e, first, "right")
    z = np.searchsorted(s, last, "left") - 1
    inside = (a == z) & (first >= s[np.minimum(a, len(s) - 1)]) & (last <= e[np.maximum(z, 0)])
    total[full] = np.bincount(a[inside], minlength=len(full))
    for k in np.flatnonzero(~inside & (a <= z)):
        which = np.arange(a[k], z[k] + 1)
        part = np.minimum(e[which], last[k]) - np.maximum(s[which], first[k])
        crossing[full[which]] += 1
        if rule == "split":
            total[full[which]] += part / part.sum()
        else:
            total[full[which[0 if rule == "start" else int(np.argmax(part))]]] += 1
    return total, crossing


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The spans of a text's lines, each with the newline that ends it."""
    cuts = np.array([m.end() for m in re.finditer("\n", text)], np.int64)
    if not len(text):
        return cuts, cuts
    ends = cuts if len(cuts) and cuts[-1] == len(text) else np.append(cuts, len(text))
    return np.append(0, ends[:-1]), ends


def attributed(docs: DataFrame, rule: str = "majority", sections: str | None = None, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing, document_tokens): one row for each section of each row of docs.

    sections: a column of docs, an array of structs (start, end) of characters in order and disjoint, reaching no further
    than the text; sections are numbered from 0 in its order. By default the sections are the lines of the text. A row
    whose text is null or empty, or that has no section, has no row in the result; null and repeated doc_ids are treated
    as any other. Other columns are ignored, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = Tokenizer(spark, path)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(sections).alias("sections")] if sections else []))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in (("section", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("tokens", T.DoubleType()), ("crossing", T.LongType()), ("document_tokens", T.LongType()))]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = tokenizer.byte_lengths()
        for batch in batches:
            row, out = [], [[] for _ in range(6)]
            given = batch.column("sections").to_pylist() if sections else None
            for k, text in enumerate(batch.column("text").to_pylist()):
                text = valid(text)
                if given is not None:
                    mine = given[k] or []
                    start, end = (np.minimum(np.array([x[n] for x in mine], np.int64), len(text)) for n in ("start", "end"))
                else:
                    start, end = lines(text)
                if not len(text) or not len(start):
                    continue
                ids = tokenizer.encode(text)
                total, crossing = allocate(*spans(ids, lengths, text.encode()), start, end, rule)
                row.append(np.full(len(start), k))
                for x, v in zip(out, (np.arange(len(start), dtype=np.int32), start, end, total, crossing, np.full(len(start), len(ids)))):
                    x.append(v)
            if row:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(row))), *[pa.array(np.concatenate(x)) for x in out]], names=schema.names)

    return rows.mapInArrow(releasing(count), schema)
