"""Order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import c
from tessera.operators.select import first_match


def latest_by_key(rows: DataFrame, keys: list[str], created: str, order: list[str]) -> DataFrame:
    """The row created last of each key; undated rows lose, and of equals the first in order stays."""
    return first_match(rows, keys, [F.desc_nulls_last(created), *order])


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without one all stay."""
    return first_match(rows.where(F.col(key).isNotNull()), [key], order).unionByName(rows.where(F.col(key).isNull()))


def tile_timings(events: DataFrame, by: list[str], time: str, order: list[str]) -> DataFrame:
    """Seconds until the next event of the same run; null for the last."""
    w = Window.partitionBy(*by).orderBy(time, *order)
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return events.withColumn("dwell", F.round((micros(F.lead(time).over(w)) - micros(F.col(time))) / 1e6, 3))


def filled_forward(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to and with each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def level_ranks(levels: DataFrame, by: list[str]) -> DataFrame:
    """Each level's place from 0, and the finest and coarsest of its pyramid."""
    w = Window.partitionBy(*by).orderBy("downsample")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return levels.withColumn("level_index", F.row_number().over(w) - 1).withColumn("finest", F.first("downsample").over(whole)).withColumn("coarsest", F.last("downsample").over(whole))


def numbered_from_zero(tiles: DataFrame, by: list[str], number: str, only_from_one: bool = True) -> DataFrame:
    """Numbers less one if their least is one (or, else, isn't zero)."""
    least = F.min(number).over(Window.partitionBy(*by))
    shift = (least == 1) if only_from_one else (least != 0)
    return tiles.withColumn(number, F.when(shift, c(number) - 1).otherwise(c(number)))


def level_for_size(levels: DataFrame, by: list[str], width: int, height: int | None = None) -> DataFrame:
    """(by, downsample): the coarsest level of at least that size (both dimensions; either one if only one is given), else the finest."""
    fits = (F.col("width") >= width) & (F.col("height") >= height) if height is not None else (F.col("width") >= width) | (F.col("height") >= width)
    return levels.groupBy(*by).agg(F.coalesce(F.max(F.when(fits, F.col("downsample"))), F.min("downsample")).alias("downsample"))


def newest(files: DataFrame, by: list[str], path: str, modified: str) -> DataFrame:
    """(by, newest, modified) of each group; the first path among equals."""
    return files.groupBy(*by).agg(F.min(F.struct((-F.unix_micros(c(modified).cast("timestamp"))).alias("t"), c(path).alias("p")))["p"].alias("newest"), F.max(modified).alias("modified"))
