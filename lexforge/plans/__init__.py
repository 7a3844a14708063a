"""The registered queries over the driver's tables, with their SQL."""

from lexforge.plans import interval_queries, lexing_queries, measure_queries, molecule_queries, source_queries, token_queries  # noqa: F401  (they register their queries)
from lexforge.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
