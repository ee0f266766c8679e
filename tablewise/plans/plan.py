"""The analytical query plan and its binding to a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

# What a plan may ask for.
OPERATIONS = (
    "aggregate",
    "group_by",
    "sort_limit",
    "filter",
    "distribution",
    "outlier_detection",
    "correlation",
    "missing_analysis",
    "general_summary",
)
AGGREGATES = ("count", "sum", "mean", "median", "min", "max", "distinct_count")
FILTER_OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "contains", "is_null", "is_not_null")
# Rows that a limit may name. More would be sorted in one task: take all rows instead.
LARGEST_LIMIT = 1_000_000


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Plan:
    operation: str
    target_columns: Sequence[str] = ()
    group_by_column: str | None = None
    aggregation_func: str | None = None
    filters: Sequence[Filter] = ()
    sort_by: str | None = None
    sort_ascending: bool = False
    # None: all rows.
    limit: int | None = None
    # Column that makes the row order total where a result depends on it.
    order_column: str | None = None
    notes: Sequence[str] = field(default=())


def match_column(name: str | None, columns: Sequence[str]) -> str | None:
    """Exact name first, then the name in any case."""
    if not name:
        return None
    if name in columns:
        return name
    return next((c for c in columns if c.lower() == name.lower()), None)


def bind(plan: Plan, columns: Sequence[str]) -> Plan:
    """The plan with its names resolved against ``columns``.

    An unknown operation and a limit outside 1..LARGEST_LIMIT are errors. Unknown
    targets, group and sort columns and filters are left out, and an unknown aggregate
    becomes ``count``.
    """
    if plan.operation not in OPERATIONS:
        raise ValueError(f"no such operation: {plan.operation!r}; known are {', '.join(OPERATIONS)}")
    if plan.limit is not None and not 1 <= plan.limit <= LARGEST_LIMIT:
        raise ValueError(f"a limit is 1 to {LARGEST_LIMIT}, or None for all rows")
    targets = [m for m in (match_column(t, columns) for t in plan.target_columns) if m]
    if not targets and columns:
        targets = [columns[0]]
    aggregate = plan.aggregation_func
    if aggregate:
        aggregate = aggregate.lower().replace("avg", "mean")
        if aggregate not in AGGREGATES:
            aggregate = "count"
    filters = []
    for f in plan.filters:
        matched = match_column(f.column, columns)
        if matched and f.operator in FILTER_OPERATORS:
            filters.append(replace(f, column=matched))
    return replace(
        plan,
        target_columns=tuple(targets),
        group_by_column=match_column(plan.group_by_column, columns),
        aggregation_func=aggregate,
        filters=tuple(filters),
        sort_by=match_column(plan.sort_by, columns),
    )
