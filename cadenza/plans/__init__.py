"""Named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from . import audits, duplicates, extended, metrics, partitions, profiles, signals, tables
from .base import rounded_alike

_GROUPS = (extended, metrics, partitions, duplicates, signals, profiles, audits, tables)


def queries() -> dict:
    return {name: f for group in _GROUPS for name, (f, _) in group.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: rounded_alike(sql) for group in _GROUPS for name, (_, sql) in group.PLANS.items() if sql}
