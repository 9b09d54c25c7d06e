"""Name -> query callable, and name -> equivalent SQL for the oracle engine."""

from lumenframe.plans import kernel_queries, relational

QUERIES: dict = relational.QUERIES | kernel_queries.QUERIES
ORACLES: dict = dict(relational.ORACLES)
