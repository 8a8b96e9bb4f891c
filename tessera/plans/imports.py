"""Imports: capture files of many sections to the tables of a volume, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import aggregates, joins, select
from tessera.sources import texts


def captures(spark: SparkSession, glob: str, overrides: DataFrame | None = None, flips: DataFrame | None = None, target_bits: int = 8, camera_bits: int | None = None, extension: str = "png", existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables "sections", "tiles" and "work" of all capture files of a glob.

    A section's number, name and downsample come of its folder; its scale of the header (tenths, as nanometers); its contrast
    is an override's or else its tiles' extremes, with gamma 1. Tiles are numbered in their file's order and moved to the
    section's origin. Work is the tiles whose target isn't in the table `existing` (section, target).
    """
    whole = spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    header, tiles = texts.idoc(whole, camera_bits)
    folder = texts.section_of_folder(header.select("file", "PixelSpacing", "DataMode", F.regexp_replace("file", "/[^/]*$", "").alias("folder")), "folder")
    m = F.col("MinMaxMean")
    values = tiles.select("file", m[0].alias("min"), m[1].alias("max"), m[2].alias("mean"))
    stats = aggregates.image_statistics(values.where("mean is not null"), ["file"])
    sections = folder.join(stats, "file", "left").withColumn("gamma", F.lit(1.0)).withColumn("nm_per_pixel", F.col("PixelSpacing") / 10).withColumn("bits", S.bits_per_pixel("DataMode", "max"))
    if overrides is not None:
        sections = joins.with_default(sections, overrides, ["section"], ["min", "max", "gamma"])
    sections = sections.withColumn("mask", S.bit_mask("min", "max", target_bits))
    if flips is not None:
        sections = sections.join(flips.select("section", F.lit(True).alias("flipped")), "section", "left").withColumn("flipped", F.coalesce("flipped", F.lit(False)))
    numbered = texts.numbered_tiles(tiles, extension).join(sections.select("file", "section"), "file")
    placed = aggregates.to_zero_origin(numbered.select("section", "ordinal", F.col("Image").alias("source"), "target", "x", "y"), ["section"])
    work = select.missing(placed, existing, ["section", "target"]) if existing is not None else placed
    return {"sections": sections, "tiles": placed, "work": work}


def log_attributes(tiles: DataFrame, header: DataFrame) -> DataFrame:
    """(file, attrs): the mean time and drift of a log's tiles and its start, in their shortest form."""
    g = lambda c: F.regexp_replace(F.format_string("%.6f", c), "\\.?0+$", "")
    means = aggregates.log_summary(tiles.withColumnRenamed("start_time", "start").withColumnRenamed("end_time", "end"), ["file"])
    return means.join(header, "file").select("file", F.map_filter(F.create_map(F.lit("AverageTileTime"), g(F.col("average_time")), F.lit("AverageTileDrift"), g(F.col("average_drift")), F.lit("CaptureTime"), g(F.col("montage_end") - F.col("montage_start")), F.lit("Startup"), F.col("startup")), lambda k, v: v.isNotNull()).alias("attrs"))


def drift_series(drifts: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is plotted of a log: (file, number, since_stop, drift) in order, and (file, x, y, size, tries) with the squared dwell as size."""
    tries = drifts.groupBy("file", "number").agg(F.count("*").alias("tries"))
    grid = tiles.join(tries, ["file", "number"], "left").select("file", "x", "y", (F.col("dwell") * F.col("dwell")).alias("size"), F.coalesce("tries", F.lit(0)).alias("tries"))
    return drifts.orderBy("file", "number", "seq"), grid
