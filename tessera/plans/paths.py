"""A small path language over element tables, compiled to joins: one join for each step.

A path is steps joined by "/": a tag or "*", and tests "[@Name='value']", "[@Name]", "[@Name<3]", "[@Name>3]". "." is the
element itself, ".." its parent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"\s*(\.\.|\.|\*|[A-Za-z_][\w.-]*)((?:\[[^\]]*\])*)\s*")
_TEST = re.compile(r"@([\w.-]+)\s*(?:(=|<|>)\s*(?:'([^']*)'|\"([^\"]*)\"|([^\s'\"]+)))?")


@dataclass(frozen=True)
class Test:
    name: str
    operator: str | None
    value: str | None

    def column(self, attrs: Column) -> Column:
        have = F.try_element_at(attrs, F.lit(self.name))
        if self.operator is None:
            return have.isNotNull()
        try:
            number: float | None = float(self.value)
        except ValueError:
            number = None
        if self.operator == "=":
            same = have == self.value
            return F.coalesce(same | (have.try_cast("double") == number) if number is not None else same, F.lit(False))
        if number is None:
            raise ValueError(f"{self.name} is compared with {self.value!r}, which is no number")
        v = have.try_cast("double")
        return F.coalesce(v < number if self.operator == "<" else v > number, F.lit(False))


def parse(path: str) -> list[tuple[str, tuple[Test, ...]]]:
    steps, rest = [], path.strip().strip("/")
    while rest:
        m = _STEP.match(rest)
        if not m or (m.end() < len(rest) and rest[m.end()] != "/"):
            raise ValueError(f"no path: {path!r}")
        tests = []
        for body in re.findall(r"\[([^\]]*)\]", m[2]):
            for part in re.split(r"\s+and\s+", body):
                t = _TEST.fullmatch(part.strip())
                if not t:
                    raise ValueError(f"no test: [{body}]")
                tests.append(Test(t[1], t[2], next((g for g in t.groups()[2:] if g is not None), None)))
        steps.append((m[1], tuple(tests)))
        rest = rest[m.end() + 1 :]
    return steps


def find_all(start: DataFrame, elements: DataFrame, path: str, binding: str = "start") -> DataFrame:
    """(binding, id, parent, ord, tag, attrs, path_ord): all matches below each start element (column id), document order by
    path_ord. Tests are filters on the step's side of its join, before it."""
    rows = start.select(F.col("id").alias(binding), "id", F.array().cast("array<long>").alias("path_ord"))
    for tag, tests in parse(path):
        if tag == ".":
            found = elements
            for t in tests:
                found = found.where(t.column(F.col("attrs")))
            rows = rows.join(found.select("id"), "id", "left_semi") if tests else rows
        elif tag == "..":
            up = elements.select(F.col("id"), F.col("parent").alias("_up")).where("_up is not null")
            rows = rows.join(up, "id").select(binding, F.col("_up").alias("id"), "path_ord")
        else:
            found = elements if tag == "*" else elements.where(F.col("tag") == tag)
            for t in tests:
                found = found.where(t.column(F.col("attrs")))
            step = found.select(F.col("parent").alias("_at"), F.col("id").alias("_id"), F.col("ord").alias("_ord"))
            rows = rows.join(step, rows["id"] == step["_at"]).select(binding, F.col("_id").alias("id"), F.concat("path_ord", F.array("_ord")).alias("path_ord"))
    return rows.join(elements.select("id", "parent", "ord", "tag", "attrs"), "id")


def find(start: DataFrame, elements: DataFrame, path: str, binding: str = "start") -> DataFrame:
    """The first match of each start element in document order; those without one are missing."""
    found = find_all(start, elements, path, binding)
    row = F.struct(*[F.col(c) for c in found.columns])
    return found.groupBy(binding).agg(F.min_by(row, F.struct("path_ord", "id")).alias("_m")).select("_m.*")


def ancestors(elements: DataFrame) -> DataFrame:
    """(id, ancestor, tag, attrs, distance) of every element and each of its ancestors, itself at distance 0."""
    from tessera.checkpoints import cut

    level = cut(elements.select("id", F.col("id").alias("ancestor"), F.col("parent").alias("_next")))
    out, distance = level.select("id", "ancestor", F.lit(0).alias("distance")), 0
    while True:
        distance += 1
        up = elements.select(F.col("id").alias("_next"), F.col("parent").alias("_up"))
        level = cut(level.where("_next is not null").join(up, "_next").select("id", F.col("_next").alias("ancestor"), F.col("_up").alias("_next")))
        if level.isEmpty():
            break
        out = out.unionByName(level.select("id", "ancestor", F.lit(distance).alias("distance")))
    return out.join(elements.select(F.col("id").alias("ancestor"), "tag", "attrs"), "ancestor")


def nearest_ancestor(elements: DataFrame, tag: str) -> DataFrame:
    """(id, ancestor): the nearest proper ancestor of a tag."""
    found = ancestors(elements).where((F.col("tag") == tag) & (F.col("distance") > 0))
    return found.groupBy("id").agg(F.min_by("ancestor", "distance").alias("ancestor"))


def inherited_attribute(elements: DataFrame, name: str) -> DataFrame:
    """(id, value): an attribute, the element's own or its nearest ancestor's that has one."""
    found = ancestors(elements).withColumn("value", F.try_element_at("attrs", F.lit(name))).where("value is not null")
    return found.groupBy("id").agg(F.min_by("value", "distance").alias("value"))


def full_paths(elements: DataFrame) -> DataFrame:
    """(id, full_path): the Path attributes of an element and its ancestors, from the root."""
    found = ancestors(elements).withColumn("p", F.try_element_at("attrs", F.lit("Path"))).where("p is not null and p <> ''")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("distance", "p")), asc=False), lambda x: x["p"])
    return found.groupBy("id").agg(F.regexp_replace(F.array_join(parts, "/"), "/{2,}", "/").alias("full_path"))
