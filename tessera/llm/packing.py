"""Packing by optimal length buckets.

Texts are cut into sequences of at most `max_len` tokens (every token is in one sequence). The histogram of all sequences'
lengths, max_len numbers at most, goes to the driver; dynamic programming over it finds the `buckets` bucket lengths with
the least padding. A sequence is padded to the least bucket length that holds it. Inside a bucket sequences are ordered by
a seeded hash and every `budget // bucket length` of them are a batch, so that only a bucket's last batch isn't full. The
hash is of doc_id, piece and the number of the copy: repetitions of a document, which follow each other where sources were
mixed, go to places of their own, and so do rows without doc_id.

The place in a bucket is found without sorting a bucket in one task: sequences are ranked inside slices of the hash's
range of some 100,000 each, and a slice's offset is the number of sequences in the slices before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written
from tessera.llm.tokens import VOCABULARY, Tokenizer, token_counts

MAX_LEN, BUCKETS, BUDGET, SEED = 2048, 16, 65_536, 11
SLICE = 100_000


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most `buckets` bucket lengths, rising, for which the padding of all sequences is least; the last is the longest length.

    O(buckets * n^2) for n different lengths, in rows of n.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    n = len(lengths)
    if not n:
        return []
    number = np.concatenate(([0], np.cumsum([histogram[k] for k in lengths.tolist()])))
    padding = lambda i, j: lengths[j - 1] * (number[j] - number[i])  # noqa: E731  the places that lengths i to j - 1 take; less their tokens, which are the same for all choices
    best = np.concatenate(([0], padding(0, np.arange(1, n + 1))))
    best = best.astype(np.int64)
    choices = []
    for _ in range(1, min(buckets, n)):
        now, choice = best.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            all_i = best[:j] + padding(np.arange(j), j)
            choice[j] = int(np.argmin(all_i))
            now[j] = all_i[choice[j]]
        best = now
        choices.append(choice)
    out, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(choice[j])
    if j:
        out.append(int(lengths[j - 1]))
    return sorted(set(out))


def sequences(docs: DataFrame, max_len: int = MAX_LEN, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, copy, piece, start, length): each row's tokens in pieces of max_len, the last of what is left. A text without tokens (null or empty) has no piece."""
    small_batches(docs.sparkSession)
    counted = token_counts(docs, Tokenizer(docs.sparkSession, path)).where("n > 0")
    pieces = counted.select("doc_id", "copy", "n", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / max_len) - 1).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    return pieces.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.lit(max_len).cast("long"), F.col("n") - start).alias("length"))


def packed(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, bucket, batch, slot) for each sequence: its bucket's length, the number of its batch
    in the bucket and its place in the batch, both from 0.

    Rows with equal doc_id are packed each by itself; which of them gets which place is open, as they're alike. Null
    doc_ids are packed as any other. Tables without a token have no rows. Other columns are ignored.
    """
    if budget < max_len:
        raise ValueError("budget must hold a sequence of max_len")
    rows = written(sequences(docs, max_len, path), "sequences")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    lengths = boundaries(histogram, buckets)
    if not lengths:
        lengths = [max_len]
    inside = {b: sum(n for k, n in histogram.items() if a < k <= b) for a, b in zip([0, *lengths], lengths)}
    bucket = F.lit(lengths[-1])
    slices = F.lit(1)
    for b in reversed(lengths):
        bucket = F.when(F.col("length") <= b, F.lit(b)).otherwise(bucket)
        slices = F.when(F.col("bucket") == b, F.lit(max(1, -(-inside[b] // SLICE)))).otherwise(slices)
    h = F.xxhash64(F.lit(seed), "doc_id", "piece", "copy")
    placed = rows.withColumn("bucket", bucket).withColumn("h", h).withColumn("slice", F.pmod(F.col("h"), slices.cast("long")))
    numbers = placed.groupBy("bucket", "slice").count()
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(numbers.select("bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "offsets")
    rank = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("h", "doc_id", "piece", "copy")) - 1
    ranked = placed.withColumn("rank", rank).join(offsets, ["bucket", "slice"]).withColumn("rank", F.col("rank") + F.col("offset"))
    each = F.floor(F.lit(budget) / F.col("bucket"))
    return ranked.select("doc_id", "piece", "start", "length", "bucket", F.floor(F.col("rank") / each).alias("batch"), (F.col("rank") % each).cast("int").alias("slot"))
