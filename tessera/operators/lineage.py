"""Validity, staleness and recomputation.

A derived row carries the fingerprint of what it was made from. It's valid as long as its input's fingerprint is the same;
what isn't valid, or isn't there, is to be computed. A locked row is always valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import cut
from tessera.functions.scalar import c
from tessera.operators.select import first_match

STAMP = ["input_name", "input_type", "input_checksum", "input_crop"]


def stamped(derived: DataFrame, inputs: DataFrame, on: list[str]) -> DataFrame:
    """Derived rows with the stamp of their input (name, type, checksum, crop)."""
    stamp = inputs.select(*on, *[F.col(s.removeprefix("input_")).alias(s) for s in STAMP])
    return derived.drop(*STAMP).join(stamp, on, "left")


def lineage_matches(prefix: str = "now_") -> Column:
    """Whether the stamp equals the columns of its names with a prefix, nulls being equal."""
    out = F.lit(True)
    for s in STAMP:
        out = out & F.col(s).eqNullSafe(F.col(prefix + s))
    return out


def reusable(locked: Column | str, matched: Column) -> Column:
    return F.coalesce(c(locked), F.lit(False)) | matched


def contrast_mismatched(low: Column, high: Column, gamma: Column, want: tuple[float, float, float]) -> Column:
    """Whether contrast differs: cutoffs at whole numbers, gamma at three places; a missing value differs."""
    tests = [F.bround(x, p).eqNullSafe(F.bround(F.lit(float(w)), p)) for x, w, p in ((low, want[0], 0), (high, want[1], 0), (gamma, want[2], 3))]
    return ~(tests[0] & tests[1] & tests[2])


def stale(recorded: Column | str, now: Column | str, input_time: Column | str, output_time: Column | str) -> Column:
    """By checksum where one is recorded, else by time; an output that isn't there is stale."""
    by_sum = ~c(recorded).eqNullSafe(c(now))
    by_time = c(input_time) > c(output_time)
    return F.when(c(output_time).isNull(), F.lit(True)).when(c(recorded).isNotNull(), by_sum).otherwise(F.coalesce(by_time, F.lit(False)))


def preferred(manual: Column | str, automatic: Column | str) -> Column:
    return F.coalesce(c(manual), c(automatic))


def validity(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """`reason` of the first rule that a row breaks (null if none) and `valid`. A rule that is unknown is broken."""
    reason = F.lit(None).cast("string")
    for holds, text in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)).otherwise(reason)
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def to_compute(inputs: DataFrame, outputs: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Inputs whose fingerprint no output has, and that no locked output stands for (by `id`)."""
    locked = outputs.where("locked").select("id")
    return inputs.join(outputs.select(key), key, "left_anti").join(locked, "id", "left_anti")


def cleaned(elements: DataFrame, invalid: DataFrame) -> DataFrame:
    """Elements (id, parent, locked, ...) without invalid ones and all below them. A locked invalid element stays, with what
    is below it; a lock below an unlocked invalid container doesn't save anything.

    Every round goes one level down from what was found last; the rounds are the depth of the tree.
    """
    gone = cut(invalid.select("id").join(elements.where(~F.coalesce("locked", F.lit(False))).select("id"), "id", "left_semi").distinct())
    edge = gone
    while not edge.isEmpty():
        below = elements.join(edge.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id")
        edge = cut(below.join(gone, "id", "left_anti"))
        gone = cut(gone.union(edge))
    return elements.join(gone, "id", "left_anti")


def first_valid_histogram(histograms: DataFrame, checksum: str, order: list[str]) -> DataFrame:
    """The first valid histogram of each filter for a transform's checksum."""
    return first_match(histograms.where(F.col("valid") & (F.col("transform_checksum") == checksum)), ["filter"], order)


def kept_checksum(stored: Column | str, content: Column | str) -> Column:
    return F.coalesce(c(stored), F.md5(c(content)))
