"""strata: table-level analytics operators for customer portfolios on Spark.

Every operator takes DataFrames (plus small parameters) and returns a DataFrame.
The core of each one is a distributed DataFrame / SQL / MLlib plan; the driver only
ever sees small, bounded aggregates (quantile edges, a handful of curve points,
model parameters).
"""

__all__ = ["sources", "functions", "operators", "plans", "session"]
