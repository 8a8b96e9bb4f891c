"""Pipelines: nested Iterate, Select, RequireSetMembership, RequireMatch and PythonCall nodes as one plan.

The rows of a pipeline are bindings: one column for each bound variable, holding an element's id. Iterate joins all matches
of a path, Select the first; requirements are filters; a call is a registered function from the bindings and elements to
a table. Nothing is interpreted row by row: each leaf call gets one plan over all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import Scope
from tessera.operators.select import in_set, matches
from tessera.plans import paths


class PipelineError(Exception):
    """Ends the run; `node` is the pipeline node where it arose."""

    def __init__(self, message: str, node: ElementTree.Element | None = None) -> None:
        super().__init__(message if node is None else f"{message}\n  in {ElementTree.tostring(node, encoding='unicode')[:300]}")


class ArgumentMissing(PipelineError):
    pass


class SearchFailed(PipelineError):
    """An Iterate that matched nothing at all."""


FUNCTIONS: dict[str, Callable[..., DataFrame | None]] = {}


def function(f: Callable[..., DataFrame | None]) -> Callable[..., DataFrame | None]:
    """Registers f(bindings, elements, **keywords) for PythonCall by its name."""
    FUNCTIONS[f.__name__] = f
    return f


class Catalogue:
    """The pipelines of an XML text."""

    def __init__(self, text: str) -> None:
        self.root = ElementTree.fromstring(text)

    def names(self) -> list[str]:
        return sorted(p.attrib["Name"] for p in self.root.iter("Pipeline"))

    def pipeline(self, name: str) -> ElementTree.Element:
        for p in self.root.iter("Pipeline"):
            if p.attrib.get("Name") == name:
                return p
        raise PipelineError(f"there is no pipeline {name!r}; there are {', '.join(self.names())}")

    def arguments(self, name: str) -> list[dict[str, str]]:
        return [dict(a.attrib) for a in self.pipeline(name).iterfind("Arguments/Argument")]


def run(pipeline: ElementTree.Element, elements: DataFrame, arguments: dict[str, Any] | None = None) -> list[DataFrame]:
    """What the pipeline's calls return, in order. Elements flagged invalid (column `valid` false) are not matched."""
    valid = elements.where(F.coalesce("valid", F.lit(True))) if "valid" in elements.columns else elements
    root = valid.where("parent is null")
    given = dict(arguments or {})
    for a in pipeline.iterfind("Arguments/Argument"):
        name = a.attrib.get("dest", a.attrib.get("flag", "").lstrip("-"))
        if name not in given:
            if a.attrib.get("required", "").lower() in ("true", "1") and "default" not in a.attrib:
                raise ArgumentMissing(f"argument {name} is missing", a)
            given[name] = a.attrib.get("default")
    out: list[DataFrame] = []
    _children(pipeline, root.select(F.col("id").alias("_row")), valid, Scope(given), out)
    return out


def _children(node: ElementTree.Element, rows: DataFrame, elements: DataFrame, scope: Scope, out: list[DataFrame]) -> None:
    """The children in order; what a child requires holds for the ones after it."""
    for child in node:
        if child.tag == "Arguments":
            continue
        handler = _HANDLERS.get(child.tag)
        if handler is None:
            raise PipelineError(f"unknown node {child.tag}", child)
        rows = handler(child, rows, elements, scope, out)


def _text(node: ElementTree.Element, name: str, scope: Scope) -> Any:
    if name not in node.attrib:
        raise ArgumentMissing(f"{node.tag} needs the attribute {name}", node)
    try:
        return scope.substitute(node.attrib[name])
    except KeyError as e:
        raise ArgumentMissing(f"no variable #{e.args[0]}", node) from None


def _start(node: ElementTree.Element, rows: DataFrame, scope: Scope) -> str:
    """The column that a path begins at: a bound variable, or the current row."""
    root = node.attrib.get("Root", node.attrib.get("RootElement"))
    if root is None:
        return "_row"
    if root.lstrip("#") not in rows.columns:
        raise PipelineError(f"{root} isn't bound", node)
    return root.lstrip("#")


def _joined(node: ElementTree.Element, rows: DataFrame, elements: DataFrame, scope: Scope, first: bool, name: str) -> DataFrame:
    at = _start(node, rows, scope)
    path = _text(node, "XPath", scope)
    start = rows.select(F.col(at).alias("id")).distinct()
    found = (paths.find if first else paths.find_all)(start, elements, path, "_from").select("_from", F.col("id").alias("_found"))
    kept = [c for c in rows.columns if c != name]
    return rows.select(*kept, F.col(at).alias("_from")).join(found, "_from").drop("_from").withColumnRenamed("_found", name)


def _iterate(node, rows, elements, scope, out):
    name = node.attrib.get("VariableName", "_iterated")
    inner = _joined(node, rows, elements, scope, False, name)
    inner = inner.withColumn("_row", F.col(name))
    if node.attrib.get("Required", "").lower() == "true" and inner.isEmpty():
        raise SearchFailed("nothing matches", node)
    _children(node, inner, elements, scope, out)
    return rows


def _select(node, rows, elements, scope, out):
    if "VariableName" not in node.attrib:
        raise ArgumentMissing("Select needs the attribute VariableName", node)
    return _joined(node, rows, elements, scope, True, node.attrib["VariableName"])


def _attribute(node, rows, elements, scope):
    at = _start(node, rows, scope)
    name = node.attrib["Attribute"]
    value = elements.select(F.col("id").alias(at), F.try_element_at("attrs", F.lit(name)).alias("_value"))
    return rows.join(value, at, "left"), F.col("_value")


def _membership(node, rows, elements, scope, out):
    wanted = _text(node, "List", scope) if "List" in node.attrib else None
    if wanted is None:
        return rows
    joined, value = _attribute(node, rows, elements, scope)
    wanted = [str(x) for x in (wanted if isinstance(wanted, (list, tuple, set)) else [wanted])]
    return joined.where(in_set(value, wanted)).drop("_value")


def _match(node, rows, elements, scope, out):
    pattern = _text(node, "RegEx", scope)
    joined, value = _attribute(node, rows, elements, scope)
    return joined.where(matches(value, pattern, case_sensitive=True)).drop("_value")


def _call(node, rows, elements, scope, out):
    name = node.attrib.get("Function", "")
    if name not in FUNCTIONS:
        raise PipelineError(f"no function {name!r} is registered", node)
    attributes = {k: v for k, v in node.attrib.items() if k not in ("Function", "Module")}
    bound = {k: v for k, v in attributes.items() if v.startswith("#") and v[1:] in rows.columns}
    parameters = {e.attrib["Name"]: e.attrib["Value"] for e in node.iterfind("Parameters/Entry")}
    try:
        call = scope.with_call({k: v for k, v in attributes.items() if k not in bound}, parameters)
    except KeyError as e:
        raise ArgumentMissing(f"no variable #{e.args[0]}", node) from None
    # a bound variable is passed as the name of its column
    made = FUNCTIONS[name](rows, elements, **{**call.keywords(), **{k: v[1:] for k, v in bound.items()}})
    if made is not None:
        out.append(made)
    return rows


_HANDLERS = {"Iterate": _iterate, "Select": _select, "RequireSetMembership": _membership, "RequireMatch": _match, "PythonCall": _call}
