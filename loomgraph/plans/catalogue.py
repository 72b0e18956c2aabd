"""All registered queries."""

from loomgraph.plans import (  # noqa: F401
    assembly_queries,
    extraction_queries,
    graph_queries,
    system_queries,
    text_queries,
)
from loomgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
