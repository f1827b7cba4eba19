"""Named queries over the given tables and their SQL counterparts."""

from levelgrid.queries import catalog, drawings, elements, plans, scans, walls  # noqa: F401
from levelgrid.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
