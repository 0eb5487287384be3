"""Strategy parameters from files and from the command line."""

from __future__ import annotations

import json
import warnings
from pathlib import Path
from typing import Any


def load_params(path: str | None, strategy: str) -> dict[str, Any]:
    """The strategy's part of a JSON or YAML file whose root maps strategies to parameters."""
    if path is None:
        return {}
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if p.suffix == ".json":
        root = json.loads(p.read_text(encoding="utf-8"))
    elif p.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML files need the yaml package") from e
        root = yaml.safe_load(p.read_text(encoding="utf-8"))
    else:
        raise ValueError(f"parameters are JSON or YAML, not {p.suffix!r}")
    if not isinstance(root, dict):
        raise ValueError("the root of a parameter file must be a mapping")
    if strategy not in root:
        warnings.warn(f"{path} has no parameters for {strategy}; defaults hold", stacklevel=2)
        return {}
    if not isinstance(root[strategy], dict):
        raise ValueError(f"parameters of {strategy} must be a mapping")
    return dict(root[strategy])


def apply_overrides(params: dict[str, Any], strategy: str, overrides: list[str]) -> dict[str, Any]:
    """strategy.name=value, deeper names with more dots; values are JSON where they parse, else text."""
    out = json.loads(json.dumps(params))
    for item in overrides:
        key, eq, raw = item.partition("=")
        path = key.strip().split(".")
        if not eq or len(path) < 2 or not all(path):
            raise ValueError(f"{item!r} isn't strategy.name=value")
        if path[0] != strategy:
            continue
        try:
            value = json.loads(raw)
        except json.JSONDecodeError:
            value = raw
        at = out
        for step in path[1:-1]:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                raise ValueError(f"{step} in {item!r} isn't a mapping")
        at[path[-1]] = value
    return out
