"""Predicates, lookups and projections over element tables.

An element table has a row for each element: id, parent, ord (document order), tag, attrs (map of text).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import c


def matches(col: Column | str, pattern: str | None, case_sensitive: bool = False) -> Column:
    """Regex match anchored at the start; None and "*" match all, also null."""
    if pattern is None or pattern == "*":
        return F.lit(True)
    return c(col).rlike(("" if case_sensitive else "(?i)") + f"^(?:{pattern})")


def in_set(col: Column | str, values: Iterable | None) -> Column:
    """Membership; no list keeps all, an empty one none."""
    if values is None:
        return F.lit(True)
    values = list(values)
    return c(col).isin(values) if values else F.lit(False)


def in_table(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Membership in a table's column of the same name."""
    return rows.join(members.select(key).distinct(), key, "left_semi")


def values_equal(a: Column | str, b: Column | str, precision: int | None = None) -> Column:
    """Null-safe equality of texts; as numbers if both are, rounded half to even if a precision is given."""
    x, y = c(a).cast("string"), c(b).cast("string")
    fx, fy = x.try_cast("double"), y.try_cast("double")
    if precision is not None:
        fx, fy = F.bround(fx, precision), F.bround(fy, precision)
    return F.when(fx.isNotNull() & fy.isNotNull(), fx == fy).otherwise(x.eqNullSafe(y))


def mismatched(have: Column, want: dict[str, str]) -> Column:
    """The names in `want` whose value the attributes don't have."""
    tests = [F.when(~F.try_element_at(have, F.lit(k)).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in want.items()]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def contains_attributes(have: Column, part: Column, ignored: tuple[str, ...] = ("CreationDate",)) -> Column:
    """Whether all attributes of `part`, but for ignored ones, are in `have` with the same values."""
    return F.forall(F.map_entries(part), lambda e: e["key"].isin(*ignored) | F.try_element_at(have, e["key"]).eqNullSafe(e["value"]))


def children(elements: DataFrame, tag: str, attributes: dict[str, object] | None = None) -> DataFrame:
    """Elements of a tag whose attributes have the given values (floats in their shortest form)."""
    found = elements.where(F.col("tag") == tag)
    for k, v in (attributes or {}).items():
        found = found.where(F.try_element_at("attrs", F.lit(k)) == (f"{v:g}" if isinstance(v, float) else str(v)))
    return found


def first_match(rows: DataFrame, partition: list[str], order: list) -> DataFrame:
    """The first row of each partition in an order; with the condition applied before, "select the first valid match"."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def two_level_match(channels: DataFrame, filters: DataFrame, on: list[str], channel_pattern: str | None, filter_pattern: str | None) -> DataFrame:
    """Filters whose own name and channel's name match."""
    return filters.where(matches("filter", filter_pattern)).join(channels.where(matches("channel", channel_pattern)), on)


def inherited(*nearest_first: Column | str) -> Column:
    return F.coalesce(*[c(x) for x in nearest_first])


def missing(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(others, on, "left_anti")


def existing(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(others, on, "left_semi")


def mapped_by(edges: DataFrame, section: int) -> DataFrame:
    """The controls of a section."""
    return edges.where(F.col("mapped") == section).select("control").distinct()


def attribute_report(elements: DataFrame, names: list[str]) -> DataFrame:
    """One text column for each attribute; missing ones are "None"."""
    return elements.select("id", *[F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit("None")).alias(n) for n in names])


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return rows.where(~F.coalesce(condition, F.lit(False)))
