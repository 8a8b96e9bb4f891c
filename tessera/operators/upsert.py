"""Changes to immutable tables: each returns the new table, or what changed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import c


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert if absent: rows with a new key are added, existing rows never change. `added` tells which they are."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)), allowMissingColumns=True)


def replaced(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same key are replaced, others added; `change` is "kept", "added" or "replaced"."""
    kept = table.join(rows.select(*keys), keys, "left_anti").withColumn("change", F.lit("kept"))
    there = table.select(*keys).distinct().withColumn("_there", F.lit(True))
    new = rows.join(there, keys, "left").withColumn("change", F.when(F.col("_there"), "replaced").otherwise("added")).drop("_there")
    return kept.unionByName(new.select(*kept.columns))


def removed(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys), keys, "left_anti")


def with_edge(edges: DataFrame, control: int, mapped: int) -> DataFrame:
    """Idempotent."""
    return edges.union(edges.sparkSession.createDataFrame([(control, mapped)], edges.select("control", "mapped").schema)).distinct()


def without_edge(edges: DataFrame, control: int, mapped: int) -> DataFrame:
    return edges.where(~((F.col("control") == control) & (F.col("mapped") == mapped)))


def updated(old: Column | str, value: float | None) -> Column:
    """A new value; NaN leaves the old one, None clears it."""
    if isinstance(value, float) and math.isnan(value):
        return c(old)
    return F.lit(value)


def with_contrast(filters: DataFrame, which: Column, low: float, high: float, gamma: float) -> DataFrame:
    """Requested contrast; NaN leaves a value. A request unlocks the filter."""
    given = not all(math.isnan(x) for x in (low, high, gamma))
    out = filters
    for name, v in (("low", low), ("high", high), ("gamma", gamma)):
        out = out.withColumn(name, F.when(which, updated(name, v)).otherwise(F.col(name)))
    return out.withColumn("locked", F.when(which & F.lit(given), F.lit(False)).otherwise(F.col("locked")))


def filled_attributes(table: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Missing attributes (map `attrs`) filled from rows of the same key; existing ones win. Unmatched rows are added."""
    other = more.select(*keys, F.col("attrs").alias("_more"))
    joined = table.join(other, keys, "full")
    mine = F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>"))
    theirs = F.map_filter(F.coalesce("_more", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(mine, k))
    return joined.withColumn("attrs", F.map_concat(mine, theirs)).drop("_more")


def renamed(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values renamed by a map; `changed` tells where."""
    new = F.col(column)
    for a, b in names.items():
        new = F.when(F.col(column) == a, F.lit(b)).otherwise(new)
    return rows.withColumn("_new", new).withColumn("changed", ~F.col("_new").eqNullSafe(F.col(column))).withColumn(column, F.col("_new")).drop("_new")


def without_default(rows: DataFrame, column: str, default: Column) -> DataFrame:
    """Entries equal to the volume's default are dropped to null."""
    return rows.withColumn(column, F.when(F.col(column).eqNullSafe(default), None).otherwise(F.col(column)))


def upgraded(rows: DataFrame, defaults: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of an older form, which lack some columns' values, filled from one row a key; `upgraded` tells where."""
    of = defaults.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    lacks = F.lit(False)
    for x in columns:
        lacks = lacks | (F.col(x).isNull() & F.col(f"_{x}").isNotNull())
    joined = rows.join(of, key, "left").withColumn("upgraded", lacks)
    return joined.select(*[F.coalesce(x, f"_{x}").alias(x) if x in columns else F.col(x) for x in rows.columns], "upgraded")
