"""Which column plays which part."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Columns:
    """Column roles. Label, group, cluster and date are defaults for strategies that take such a column."""

    id: str = "id"
    sequence: str = "sequence"
    label: str | None = "label"
    group: str | None = None
    cluster: str | None = None
    date: str | None = None
