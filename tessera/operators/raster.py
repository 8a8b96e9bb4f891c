"""Raster operators. Pixels are rows (tile, y, x, v) or a row-major array; sizes of tiles don't change the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import c


def pixels(tiles: DataFrame, values: str, width: int, keep: list[str]) -> DataFrame:
    """(keep, y, x, v) of row-major arrays."""
    flat = tiles.select(*keep, F.posexplode(values).alias("_i", "v"))
    return flat.select(*keep, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def pruned(tiles: DataFrame, by: list[str], score: str, threshold: float | Column | None) -> DataFrame:
    """Tiles that score at least the threshold (0 if there is none; two places). Tiles without a score go. A section that
    would lose all its tiles keeps them: the request is refused.

    The guard is an aggregate by section joined back: a section of any number of tiles is never in one task.
    """
    t = F.bround(threshold if isinstance(threshold, Column) else F.lit(float(threshold or 0.0)), 2)
    passing = F.col(score) >= t
    guard = tiles.groupBy(*by).agg(F.max(F.when(passing, 1).otherwise(0)).alias("_some"))
    return tiles.join(guard, by).where(((F.col("_some") == 1) & passing) | (F.col("_some") == 0)).drop("_some")


def stretched(v: Column | str, low: Column | float, high: Column | float, gamma: Column | float = 1.0) -> Column:
    """Contrast stretched to [0, 1]; a reversed range is put right, an empty one is 0 below and 1 above."""
    lo, hi, g = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high, gamma))
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    part = F.when(b > a, (c(v) - a) / (b - a)).otherwise(F.when(c(v) > a, 1.0).otherwise(0.0))
    return F.pow(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)), F.lit(1.0) / g)


def inverted(v: Column | str, bits: int) -> Column:
    return F.lit((1 << bits) - 1) - c(v)


def shrunk(px: DataFrame, by: list[str], factor: int) -> DataFrame:
    """Means of factor by factor blocks."""
    f = lambda n: F.floor(F.col(n) / factor).cast("int")
    return px.groupBy(*by, f("y").alias("y"), f("x").alias("x")).agg(F.avg("v").alias("v"))


def tile_pyramid(px: DataFrame, by: list[str], levels: list[int]) -> DataFrame:
    """Each level from the one before, all with the column downsample. Levels must divide each other."""
    out, now, at = None, px, 1
    for level in sorted(set(levels)):
        if level % at:
            raise ValueError(f"level {level} can't be made from {at}")
        now = shrunk(now, by, level // at) if level > at else now
        at = level
        one = now.withColumn("downsample", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


def next_tileset_level(cells: DataFrame, by: list[str]) -> DataFrame:
    """Two by two neighbours (tile_x, tile_y, v) merged to one of half their size; a missing one is black. None of four, no tile."""
    f = lambda n: F.floor(F.col(n) / 2).cast("int")
    return cells.groupBy(*by, f("tile_x").alias("tile_x"), f("tile_y").alias("tile_y")).agg((F.sum("v") / 4).alias("v"))


def tileset_levels(grid_x: int, grid_y: int, first: int = 1, last: int | None = None) -> list[tuple[int, int, int]]:
    """(downsample, grid_x, grid_y) of the levels above the first: halved until the next would be a single tile, or to `last`."""
    out, d = [], first
    while True:
        grid_x, grid_y, d = -(-grid_x // 2), -(-grid_y // 2), d * 2
        if (grid_x <= 1 and grid_y <= 1) or (last is not None and d > last):
            return out
        out.append((d, grid_x, grid_y))


def in_grid(points: DataFrame, width: float, height: float, x: str = "x", y: str = "y") -> DataFrame:
    """The cell (tile_x, tile_y) of a fixed grid that holds each point."""
    return points.withColumn("tile_x", F.floor(F.col(x) / width)).withColumn("tile_y", F.floor(F.col(y) / height))


def cut_to_grid(px: DataFrame, by: list[str], size: int) -> DataFrame:
    """An image's pixels as tiles (tile_x, tile_y) of size by size, edges padded with black."""
    known = px.select(*by, F.floor(F.col("x") / size).cast("int").alias("tile_x"), F.floor(F.col("y") / size).cast("int").alias("tile_y"), (F.col("x") % size).alias("x"), (F.col("y") % size).alias("y"), "v")
    inside = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1)))
    every = known.select(*by, "tile_x", "tile_y").distinct().withColumn("_i", inside).select(*by, "tile_x", "tile_y", (F.col("_i") % size).cast("int").alias("x"), F.floor(F.col("_i") / size).cast("int").alias("y"))
    return every.join(known, [*by, "tile_x", "tile_y", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def assembled(px: DataFrame, by: list[str], distance: str) -> DataFrame:
    """One value for each place: of the tile whose center is nearest, the first tile of equals."""
    return px.groupBy(*by, "y", "x").agg(F.min_by("v", F.struct(F.col(distance), F.col("tile"))).alias("v"))


def shading(px: DataFrame, by: list[str], kind: str = "avg") -> DataFrame:
    """(by, y, x, shade): the minimum, maximum or mean of all tiles at each place."""
    f = {"min": F.min, "max": F.max, "avg": F.avg}[kind]
    return px.groupBy(*by, "y", "x").agg(f("v").alias("shade"))


def unshaded(px: DataFrame, shade: DataFrame, by: list[str], bright: bool = False) -> DataFrame:
    """Pixels less the shade, or, for bright field, divided by it and scaled to its mean. The shade is one tile large."""
    if not bright:
        return px.join(shade, [*by, "y", "x"]).withColumn("v", F.col("v") - F.col("shade")).drop("shade")
    mean = shade.groupBy(*by).agg(F.avg("shade").alias("_mean")) if by else shade.agg(F.avg("shade").alias("_mean"))
    joined = px.join(shade, [*by, "y", "x"])
    joined = joined.join(mean, by) if by else joined.crossJoin(F.broadcast(mean))
    return joined.withColumn("v", F.when(F.col("shade") != 0, F.col("v") / F.col("shade") * F.col("_mean")).otherwise(F.col("v"))).drop("shade", "_mean")


def less_minimum(px: DataFrame, by: list[str]) -> DataFrame:
    least = px.groupBy(*by).agg(F.min("v").alias("_least"))
    return px.join(least, by).withColumn("v", F.col("v") - F.col("_least")).drop("_least")


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, y, x, v): absolute differences of two images' pixels."""
    return a.join(b.withColumnRenamed("v", "_v"), [*on, "y", "x"]).withColumn("v", F.abs(F.col("v") - F.col("_v"))).drop("_v")


def blobs(px: DataFrame, by: list[str], radius: int = 1) -> DataFrame:
    """Medians of square neighbourhoods, cut at the image's edges. Every pixel is sent to its neighbours' places: rows
    grow by (2 radius + 1) squared and are combined before the shuffle's end, with no image in one task."""
    around = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    sent = px.select(*by, "y", "x", "v", F.explode(around).alias("_dy")).select("*", F.explode(around).alias("_dx"))
    median = sent.groupBy(*by, (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")).agg(F.median("v").alias("v"))
    return median.join(px.select(*by, "y", "x"), [*by, "y", "x"], "left_semi")


def running_extent(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The greatest value so far in an order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.max(value).over(w))


def edge_scores(px: DataFrame, by: list[str], width: int, height: int, overlap: float = 0.1) -> DataFrame:
    """(by, score): how much texture a tile shows where it overlaps others: of the four strips along its edges, `overlap` of
    its size wide and at least a pixel, the mean of the values' standard deviations."""
    w, h = max(1, round(width * overlap)), max(1, round(height * overlap))
    strips = (F.col("x") < w, F.col("x") >= width - w, F.col("y") < h, F.col("y") >= height - h)
    parts = [F.coalesce(F.stddev_pop(F.when(s, F.col("v"))), F.lit(0.0)) for s in strips]
    return px.groupBy(*by).agg(((parts[0] + parts[1] + parts[2] + parts[3]) / 4).alias("score"))


def warped(px: DataFrame, transforms: DataFrame, by: list[str], width: int, height: int, empty: float = 0.0) -> DataFrame:
    """(by, y, x, v): images of width by height in the volume's space, each place with the value at the nearest place of its
    source. The affine transforms (by, a, b, c, d, tx, ty) lead from the volume to the source; places beyond it are empty."""
    n = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    places = transforms.withColumn("_i", n).withColumn("_x", F.col("_i") % width).withColumn("_y", F.floor(F.col("_i") / width).cast("int"))
    nearest = lambda p, q, t: F.floor(F.col(p) * F.col("_x") + F.col(q) * F.col("_y") + F.col(t) + 0.5).cast("int")
    asked = places.select(*by, "_y", "_x", nearest("a", "b", "tx").alias("x"), nearest("c", "d", "ty").alias("y"))
    return asked.join(px, [*by, "y", "x"], "left").select(*by, F.col("_y").alias("y"), F.col("_x").cast("int").alias("x"), F.coalesce("v", F.lit(empty)).alias("v"))


def bars(histograms: DataFrame, by: list[str], bin_: str, count: str, height: int) -> DataFrame:
    """(by, y, x, v): a picture of each histogram, a column a bin: 255 in a bar, whose height is its share of the largest
    count, and 0 above it. y counts from the top."""
    most = histograms.groupBy(*by).agg(F.max(count).alias("_most"))
    tall = F.floor(F.col(count) * height / F.greatest(F.col("_most"), F.lit(1)))
    rows = histograms.join(most, by).select(*by, F.col(bin_).cast("int").alias("x"), tall.alias("_tall"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select(*by, "y", "x", F.when(F.lit(height) - F.col("y") <= F.col("_tall"), 255).otherwise(0).alias("v"))
