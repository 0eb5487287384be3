"""Strategies by name, built strictly: an unknown parameter is an error."""

from __future__ import annotations

from dataclasses import MISSING, fields
from typing import Any

from ..operators import hybrids, reducers, splitters

KINDS = {"reduce": reducers.STRATEGIES, "split": splitters.STRATEGIES | hybrids.STRATEGIES}


def strategy(kind: str, name: str) -> type:
    known = KINDS[kind]
    if name not in known:
        raise KeyError(f"no {kind} strategy {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def build(kind: str, name: str, params: dict[str, Any] | None = None):
    cls = strategy(kind, name)
    allowed = [f.name for f in fields(cls)]
    if unknown := sorted(set(params or {}) - set(allowed)):
        raise ValueError(f"{name} has no parameters {unknown}; it takes {allowed}")
    return cls(**(params or {}))


def defaults(kind: str, name: str) -> dict[str, Any]:
    return {f.name: (f.default if f.default is not MISSING else f.default_factory()) for f in fields(strategy(kind, name))}
