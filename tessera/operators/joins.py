"""Joins: pairs by edge, lookups with defaults, as-of levels, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.select import first_match, matches


def filter_pairs(edges: DataFrame, filters: DataFrame, channels: str | None = None, names: str | None = None) -> DataFrame:
    """For each edge (control, mapped) every filter of the mapped section with every one of the control section, both matching."""
    chosen = filters.where(matches("channel", channels) & matches("filter", names)).select("section", "channel", "filter")
    side = lambda s: chosen.select(F.col("section").alias(s), F.col("channel").alias(f"{s}_channel"), F.col("filter").alias(f"{s}_filter"))
    return edges.select("control", "mapped").join(side("control"), "control").join(side("mapped"), "mapped")


SIX = ["control", "control_channel", "control_filter", "mapped", "mapped_channel", "mapped_filter"]


def first_transform(pairs: DataFrame, transforms: DataFrame, order: list, keys: list[str] = SIX) -> DataFrame:
    """Pairs with the first transform of the same key; pairs without one go."""
    return pairs.join(first_match(transforms, keys, order), keys)


def volume_mapping(channels: DataFrame, edges: DataFrame, transforms: DataFrame, on: list[str] = ["section"]) -> DataFrame:
    """Channels with the transform into the volume: those of sections no edge maps stay as they are (transform null); of a
    mapped section only channels with a transform stay."""
    mapped = edges.select(F.col("mapped").alias(on[0])).distinct().withColumn("_mapped", F.lit(True))
    joined = channels.join(mapped, on[0], "left").join(transforms.withColumn("_found", F.lit(True)), on, "left")
    return joined.where(F.col("_mapped").isNull() | F.col("_found").isNotNull()).drop("_mapped", "_found")


def with_default(rows: DataFrame, overrides: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Each column of an override wins over the row's own where it isn't null."""
    other = overrides.select(*on, *[F.col(x).alias(f"_{x}") for x in columns])
    joined = rows.join(other, on, "left")
    return joined.select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in columns else F.col(x) for x in rows.columns])


def finer_level(levels: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """For each wanted (by, downsample) the greatest existing level strictly below it; null if there is none."""
    return _asof(levels, wanted, by, F.max, lambda have, d: have < d, "finer")


def coarser_level(levels: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """For each wanted (by, downsample) the least existing level strictly above it; null if there is none."""
    return _asof(levels, wanted, by, F.min, lambda have, d: have > d, "coarser")


def _asof(levels: DataFrame, wanted: DataFrame, by: list[str], pick, test, name: str) -> DataFrame:
    # levels of one image are few (powers of two), so they're joined as one array a key, and every wanted row picks in it
    arrays = levels.groupBy(*by).agg(F.collect_set("downsample").alias("_levels"))
    joined = wanted.join(arrays, by, "left")
    fitting = F.filter("_levels", lambda x: test(x, F.col("downsample")))
    best = F.array_max(fitting) if pick is F.max else F.array_min(fitting)
    return joined.withColumn(name, best).drop("_levels")


def level_by_halving(levels: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The nearest existing level among downsample, downsample / 2, downsample / 4, ...; null if none of them exists."""
    arrays = levels.groupBy(*by).agg(F.collect_set(F.col("downsample").cast("double")).alias("_levels"))
    joined = wanted.join(arrays, by, "left")
    steps = lambda x: F.log2(F.col("downsample").cast("double") / x)
    fitting = F.filter("_levels", lambda x: (x <= F.col("downsample")) & (F.abs(steps(x) - F.round(steps(x))) < 1e-9))
    return joined.withColumn("source_level", F.array_max(fitting)).drop("_levels")


def integrity(transforms: DataFrame, filters: DataFrame) -> DataFrame:
    """transforms with the reason why each is an orphan, else null: of the control side first, the outermost missing level."""
    known = [["section"], ["section", "channel"], ["section", "channel", "filter"]]
    out, reason = transforms, F.lit(None).cast("string")
    tests: list[tuple[Column, str]] = []
    for side in ("control", "mapped"):
        of = {"section": side, "channel": f"{side}_channel", "filter": f"{side}_filter"}
        for keys in known:
            flag = f"_{side}_{keys[-1]}"
            there = filters.select(*[F.col(k).alias(of[k]) for k in keys]).distinct().withColumn(flag, F.lit(True))
            out = out.join(there, [of[k] for k in keys], "left")
            tests.append((F.col(flag).isNull(), f"{side} {keys[-1]} missing"))
    for test, text in reversed(tests):
        reason = F.when(test, text).otherwise(reason)
    return out.select(*transforms.columns, reason.alias("reason"))


def valid_transforms(transforms: DataFrame, filters: DataFrame) -> DataFrame:
    """Without orphans: two semi joins."""
    for side in ("control", "mapped"):
        there = filters.select(F.col("section").alias(side), F.col("channel").alias(f"{side}_channel"), F.col("filter").alias(f"{side}_filter"))
        transforms = transforms.join(there, [side, f"{side}_channel", f"{side}_filter"], "left_semi")
    return transforms


def dependents(nodes: DataFrame, checksum: str, kind: str) -> DataFrame:
    """Nodes made from an input with this checksum and type."""
    return nodes.where((F.col("input_checksum") == checksum) & (F.col("input_type") == kind))
