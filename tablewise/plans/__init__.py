"""Analytical plans: what to compute on a table."""

from .plan import Filter, Plan, bind
from .run import Result, as_points, run

__all__ = ["Filter", "Plan", "Result", "as_points", "bind", "run"]
