"""Property-graph analytics expressed as Spark plans.

A corpus (files or tables) becomes two DataFrames, ``nodes`` and ``edges``;
every operator is a function from DataFrames to DataFrames.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
