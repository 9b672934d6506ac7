"""All registered queries with their SQL counterparts."""

from threadloom.plans import more as _more  # noqa: F401  registers on import
from threadloom.plans import reports as _reports  # noqa: F401
from threadloom.plans import search as _search  # noqa: F401
from threadloom.plans import stores as _stores  # noqa: F401
from threadloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
