"""The registered queries and their oracle SQL."""

from tidebook.queries import control, lattice, models, orders, trading  # noqa: F401
from tidebook.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
