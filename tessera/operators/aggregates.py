"""Aggregations: logs, images, histograms, bounds, levels, best registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import c


def log_summary(tiles: DataFrame, by: list[str] = []) -> DataFrame:
    """Of tiles (dwell, drift, start, end): the numbers, mean and extreme dwell and drift. Tiles without dwell or drift count
    for the whole time and the number of tiles only."""
    timed = F.col("dwell").isNotNull() & F.col("drift").isNotNull()
    of = lambda f, x: f(F.when(timed, F.col(x)))
    return tiles.groupBy(*by).agg(F.count("*").alias("tiles"), F.count_if(timed).alias("timed_tiles"), of(F.avg, "dwell").alias("average_time"), of(F.min, "dwell").alias("fastest_time"), of(F.avg, "drift").alias("average_drift"), of(F.max, "drift").alias("max_drift"), of(F.min, "drift").alias("min_drift"), (F.max("end") - F.min("start")).alias("total_time"))


def image_statistics(tiles: DataFrame, by: list[str] = [], camera_bits: int | None = None) -> DataFrame:
    """Greatest maximum, least minimum (0 at least) and mean of means; values beyond the camera's bits count as its largest."""
    top = (lambda x: F.least(x, F.lit(float(1 << camera_bits)))) if camera_bits else (lambda x: x)
    return tiles.groupBy(*by).agg(F.max(top(F.col("max"))).alias("max"), F.greatest(F.min(top(F.col("min"))), F.lit(0.0)).alias("min"), F.avg(F.col("mean")).alias("mean"))


def bucket(value: Column | str, least: Column | str, most: Column | str, bins: Column | int) -> Column:
    """Which of `bins` equal parts of [least, most] holds a value; the last one has `most` too, and no range is part 0."""
    n = bins if isinstance(bins, Column) else F.lit(bins)
    width = c(most) - c(least)
    return F.when(width > 0, F.greatest(F.lit(0), F.least(F.floor((c(value) - c(least)) / width * n), n - 1))).otherwise(0).cast("long")


def histogram(rows: DataFrame, value: str, bins: int, by: list[str] = []) -> DataFrame:
    """(by, bucket, n, low, high): counts of values in equal parts of each group's range, and that range. Nulls don't count.

    The range is an aggregate of its own, joined by group: two partial aggregations, no window over all rows.
    """
    values = rows.where(F.col(value).isNotNull())
    span = values.groupBy(*by).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    joined = values.join(span, by) if by else values.crossJoin(F.broadcast(span))
    return joined.groupBy(*by, bucket(value, "low", "high", bins).alias("bucket"), "low", "high").agg(F.count("*").alias("n"))


def score_histogram(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Histogram with parts of a tenth of the sample's standard deviation: at least 10, then at most as many as values."""
    stats = rows.groupBy(*by).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(value).alias("values"))
    wanted = F.when(F.col("deviation") > 0, F.ceil(F.round((F.col("high") - F.col("low")) / (F.col("deviation") / 10), 6))).otherwise(10)
    stats = stats.withColumn("bins", F.least(F.greatest(wanted, F.lit(10)), F.col("values")))
    return rows.where(F.col(value).isNotNull()).join(stats, by).groupBy(*by, "bins", bucket(value, "low", "high", F.col("bins")).alias("bucket")).agg(F.count("*").alias("n"))


def cutoffs(counts: DataFrame, low_share: float, high_share: float, bins: int, by: list[str] = []) -> DataFrame:
    """(by, low_cutoff, high_cutoff) of histograms: the lower edge of the first part by which more than low_share of the
    values are passed, and the upper edge of the last part above whose lower edge more than high_share lie."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    up, down = w.orderBy("bucket"), w.orderBy(F.desc("bucket"))
    shares = counts.withColumn("_all", F.sum("n").over(w)).withColumn("_up", F.sum("n").over(up) / F.col("_all")).withColumn("_down", F.sum("n").over(down) / F.col("_all"))
    edge = lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / bins
    return shares.groupBy(*by).agg(F.min(F.when(F.col("_up") > low_share, edge(F.col("bucket")))).alias("low_cutoff"), F.max(F.when(F.col("_down") > high_share, edge(F.col("bucket") + 1))).alias("high_cutoff"))


def chosen_cutoffs(rows: DataFrame) -> DataFrame:
    """Requested values win over computed ones, which are widened to whole numbers; NaN requests are none. A minimum above
    the maximum is an error."""
    asked = lambda n: F.nanvl(F.col(n), F.lit(None).cast("double"))
    low = F.coalesce(asked("user_low"), F.floor("low_cutoff").cast("double"))
    high = F.coalesce(asked("user_high"), F.ceil("high_cutoff").cast("double"))
    out = rows.withColumn("low", low).withColumn("high", high).withColumn("gamma", F.coalesce(asked("user_gamma"), F.lit(1.0)))
    return out.where(F.when(F.col("low") > F.col("high"), F.raise_error(F.lit("minimum cutoff above maximum"))).otherwise(F.lit(True)).isNotNull())


def bounds(tiles: DataFrame, by: list[str] = []) -> DataFrame:
    """The box around tiles (x, y, width, height)."""
    return tiles.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))


def to_zero_origin(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Positions less their group's least ones. An aggregate joined back, so that a large group isn't sorted or held."""
    least = tiles.groupBy(*by).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    joined = tiles.join(least, by) if by else tiles.crossJoin(F.broadcast(least))
    return joined.withColumn("x", F.col("x") - F.col("_x")).withColumn("y", F.col("y") - F.col("_y")).drop("_x", "_y")


def volume_scale(scales: DataFrame) -> DataFrame:
    """The least units per pixel and the unit; several units are an error."""
    found = scales.agg(F.min("units_per_pixel").alias("units_per_pixel"), F.min("unit").alias("unit"), F.count_distinct("unit").alias("_n"))
    return found.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("scales have several units"))).otherwise(F.lit(True)).isNotNull()).drop("_n")


def mapped_to_controls(edges: DataFrame) -> DataFrame:
    """(mapped, controls): the sorted distinct controls as text."""
    return edges.groupBy("mapped").agg(F.array_join(F.transform(F.array_sort(F.collect_set("control")), lambda x: x.cast("string")), ",").alias("controls"))


def best_of(candidates: DataFrame, by: list[str], cost: str, order: list[str]) -> DataFrame:
    """The candidate with the least cost of each group, the first in order among equals; a candidate without cost wins only
    if it is alone. One aggregation, no sort."""
    rank = F.struct(F.col(cost).isNull().alias("n"), F.col(cost).alias("c"), *[F.col(x).alias(f"o{k}") for k, x in enumerate(order)])
    row = F.struct(*[F.col(x) for x in candidates.columns])
    best = candidates.groupBy(*by).agg(F.min_by(row, rank).alias("_best"), F.count("*").alias("candidates"))
    return best.where(F.col(f"_best.{cost}").isNotNull() | (F.col("candidates") == 1)).select("_best.*", "candidates")


def populated(levels: DataFrame) -> DataFrame:
    """Of levels (files, tiles, last_column, grid_x): whether each is complete, and the reason if not."""
    reason = F.when(F.coalesce(F.col("files"), F.lit(0)) == 0, "no files").when(F.col("files") > F.col("tiles"), "too many files").when(F.col("last_column").isNotNull() & (F.col("last_column") != F.col("grid_x") - 1), "last column missing")
    return levels.withColumn("reason", reason).withColumn("populated", F.col("reason").isNull())


def verified(tiles: DataFrame, by: list[str]) -> DataFrame:
    """(by, tiles_validated, invalid) of tiles with a flag `valid`."""
    return tiles.groupBy(*by).agg(F.count_if(F.col("valid")).alias("tiles_validated"), F.count_if(~F.coalesce(F.col("valid"), F.lit(False))).alias("invalid"))


def warp_histogram(points: DataFrame, edges: DataFrame, by: list[str], width: float = 1.0, most: float | None = None) -> DataFrame:
    """(by, bin, edges): by how many degrees a transform turns the edges of its mesh, in bins of `width`.

    points: (by, point, x, y, to_x, to_y); edges: (by, p, q). A turn is between 0 and 180; one beyond `most` counts as it.
    Edges without length on either side have no direction and are left out.
    """
    end = lambda e: points.select(*by, F.col("point").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in ("x", "y", "to_x", "to_y")])
    both = edges.select(*by, "p", "q").join(end("p"), [*by, "p"]).join(end("q"), [*by, "q"])
    d = lambda c: F.col(f"q_{c}") - F.col(f"p_{c}")
    some = ((d("x") != 0) | (d("y") != 0)) & ((d("to_x") != 0) | (d("to_y") != 0))
    turn = F.abs(F.degrees(F.atan2(d("to_y"), d("to_x")) - F.atan2(d("y"), d("x"))))
    turn = F.least(turn, F.lit(360.0) - turn)
    turn = F.least(turn, F.lit(float(most))) if most is not None else turn
    return both.where(some).groupBy(*by, F.floor(turn / width).alias("bin")).agg(F.count("*").alias("edges"))
