"""Named queries on the given tables. Importing this registers all of them."""

from headwater.plans import graphs, lineage, relational, scripts  # noqa: F401
from headwater.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
