"""Set operations on sections and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(sections: DataFrame, more: DataFrame) -> DataFrame:
    """Union."""
    return sections.union(more.select(*sections.columns)).distinct()


def unmarked(sections: DataFrame, less: DataFrame) -> DataFrame:
    """Difference."""
    return sections.select("*").distinct().join(less.select(*sections.columns), sections.columns, "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def allowed_edges(edges: DataFrame, banned: DataFrame) -> DataFrame:
    """Edges whose control isn't banned."""
    return edges.join(banned.select(F.col("section").alias("control")).distinct(), "control", "left_anti")


def merged_controls(mappings: DataFrame) -> DataFrame:
    """Rows (control, mapped array) of one control merged: the sorted distinct union."""
    return mappings.select("control", F.explode("mapped").alias("m")).groupBy("control").agg(F.array_sort(F.collect_set("m")).alias("mapped"))


def valid_mappings(mappings: DataFrame, banned: DataFrame) -> DataFrame:
    """Merged, without banned controls and without controls that map nothing."""
    return allowed_edges(merged_controls(mappings), banned).where(F.size("mapped") > 0)
