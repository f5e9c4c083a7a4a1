"""Status vocabularies as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coord.schemas import EFFORT_RANK, IMPACT_RANK, STATUS_ALIASES, STATUS_EMOJI, TASK_STATUSES, TERMINAL_STATUSES


def lookup(col: Column, table: dict, default: Column | None = None) -> Column:
    """CASE expression over a small fixed mapping."""
    expr = reduce(lambda acc, kv: acc.when(col == F.lit(kv[0]), F.lit(kv[1])), table.items(), F)
    return expr.otherwise(default) if default is not None else expr


def canonical_status(col: Column) -> Column:
    """Lower-cased status with known other spellings replaced; null when it is none of the eight."""
    raw = F.lower(F.trim(col))
    named = lookup(raw, STATUS_ALIASES, raw)
    return F.when(named.isin(TASK_STATUSES), named)


def is_terminal(col: Column) -> Column:
    return col.isin(TERMINAL_STATUSES)


def emoji(col: Column) -> Column:
    return lookup(col, STATUS_EMOJI)


def effort_rank(col: Column) -> Column:
    return lookup(col, EFFORT_RANK)


def impact_rank(col: Column) -> Column:
    return lookup(col, IMPACT_RANK)
