"""Driver-side values: argument texts, variables, and the names' formats."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any


def integer_list(text: str) -> list[int]:
    """"1, 3,5-7,9" is [1, 3, 5, 6, 7, 9]."""
    out: list[int] = []
    for part in re.sub(r"\s", "", text).split(","):
        if not part:
            continue
        first, _, last = part.partition("-") if not part.startswith("-") else (part, "", "")
        out += range(int(first), int(last) + 1) if last else [int(first)]
    return out


def number_pair(text: str, kind: type = int) -> tuple:
    """"256" is (256, 256), "256,128" is (256, 128)."""
    parts = [kind(x) for x in re.split(r"[,\s]+", text.strip()) if x]
    if len(parts) not in (1, 2):
        raise ValueError(f"one or two numbers are needed, not {text!r}")
    return (parts[0], parts[-1])


def typed(text: Any) -> Any:
    """A text as a boolean, whole number or float if it is one."""
    if not isinstance(text, str):
        return text
    if text.strip().lower() in ("true", "false"):
        return text.strip().lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


_NAME = re.compile(r"#([A-Za-z_][A-Za-z0-9_.]*)")


def substituted(text: str, variables: Mapping[str, Any]) -> Any:
    """text with each #Name replaced, the longest name that is known first; a text that is one #Name is the value itself.

    #Name.Attr reads an attribute or key of the value. An unknown name is a KeyError.
    """
    if not isinstance(text, str) or "#" not in text:
        return text

    def find(name: str) -> tuple[Any, str]:
        for end in range(len(name), 0, -1):
            if name[:end] in variables:
                value, rest = variables[name[:end]], name[end:]
                while rest.startswith(".") and len(rest) > 1:
                    attr, _, more = rest[1:].partition(".")
                    value = value[attr] if isinstance(value, Mapping) else getattr(value, attr)
                    rest = "." + more if more else ""
                return value, rest
        raise KeyError(name)

    whole = _NAME.fullmatch(text)
    if whole:
        value, rest = find(whole[1])
        return f"{value}{rest}" if rest else value

    def one(m: re.Match) -> str:
        value, rest = find(m[1])
        return f"{value}{rest}"

    return _NAME.sub(one, text)


class Scope:
    """Names in four layers: a call's parameters, its attributes, variables bound by the pipeline, command-line arguments.

    Arguments win over variables in substitution; a call sees all of them as keywords, parameters also as one mapping.
    """

    def __init__(self, arguments: Mapping[str, Any] | None = None) -> None:
        self.arguments = dict(arguments or {})
        self.variables: dict[str, Any] = {}
        self.attributes: dict[str, Any] = {}
        self.parameters: dict[str, Any] = {}

    def names(self) -> dict[str, Any]:
        return {**self.parameters, **self.attributes, **self.variables, **self.arguments}

    def bind(self, name: str, value: Any) -> Scope:
        """A scope in which the name is bound too; this one doesn't change."""
        new = Scope(self.arguments)
        new.variables = {**self.variables, name: value}
        return new

    def with_call(self, attributes: Mapping[str, str], parameters: Mapping[str, str]) -> Scope:
        new = Scope(self.arguments)
        new.variables = dict(self.variables)
        for k, v in attributes.items():
            if k in new.attributes:
                raise ValueError(f"attribute {k} is given twice")
            new.attributes[k] = typed(substituted(v, self.names()))
        new.parameters = {k: typed(substituted(v, self.names())) for k, v in parameters.items()}
        return new

    def substitute(self, text: str) -> Any:
        return substituted(text, self.names())

    def keywords(self) -> dict[str, Any]:
        return {**self.variables, **self.arguments, **self.attributes, "parameters": self.parameters}
