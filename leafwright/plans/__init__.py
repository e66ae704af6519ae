"""Ready queries over the driver's tables, and the extraction facade."""

from . import flow_queries, geometry_queries, service_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
